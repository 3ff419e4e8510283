"""Personal data by weak supervision (operator 1): DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import hinted, one_per_id, table, whole_text

# First names, marks that open issued keys, titles, words before a secret.
FIRST_NAMES = ("james john robert michael william david richard thomas charles mary patricia jennifer linda elizabeth "
               "barbara susan jessica sarah karen anna maria peter paul hans klaus wolfgang jürgen sabine petra monika "
               "pierre jean jacques michel marie françoise isabelle sophie josé juan carlos luis miguel carmen ana lucía "
               "pedro ahmed mohamed fatima wei li ming yuki hiroshi olga ivan dmitri").split()
KEY_MARKS = "ghp_ gho_ ghu_ ghs_ github_pat_ glpat- sk- xoxa- xoxb- xoxp- xoxr- AKIA ASIA AIza".split()
TITLES = r"(?:[Nn]ame is|Mrs?\.?|Ms\.?|Dr\.?|Herr|Frau|Monsieur|Madame|Señora?)"
SECRET_WORDS = r"(?:password|passwd|pwd|secret|token|api[_\-]?key)"

# Candidate patterns.  Quantifiers are possessive and starts anchored where that
# changes no match, so that a long run of characters is read once.  Persons are
# proposed by context (what follows a title) and by the list (a listed first name
# and what follows it), secrets by context (the value after a secret's word) and
# by the list (marks of issued keys); the words around them are not in the span.
_LOCAL = r"A-Za-z0-9._%+\-"
_VALUE = r"A-Za-z0-9_+/\-"
_NAME = r"\p{Lu}\p{Ll}+"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20\-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9\-]+[0-9]",
    "id": r"(?=[0-9A-Z])(?<![A-Za-z0-9\-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[0-9]{1,3}|[A-Z0-9]{1,3})?+)(?![A-Za-z0-9\-])",
    "secret": rf"(?=[{_VALUE}])(?<![{_VALUE}])(?:(?:{'|'.join(KEY_MARKS)})[{_VALUE}]{{8,}}+"
              rf"|(?<=(?<![A-Za-z])(?i:{SECRET_WORDS})\x20?[=:]\x20?[\"']?)[{_VALUE}]{{8,}}+"
              rf"|(?<=(?<![A-Za-z])(?i:{SECRET_WORDS})\x20)(?=[A-Za-z_+/\-]*+[0-9])[{_VALUE}]{{8,}}+)",
    "person": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:(?<=(?<!\p{{L}}){TITLES}\x20){_NAME}(?:\x20{_NAME}){{0,2}}"
              rf"|(?:{'|'.join(n.capitalize() for n in FIRST_NAMES)})(?:\x20{_NAME}){{1,2}})",
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
#: Characters of which a text must hold one to be searched at all.
NEEDS = {"email": ("@",), "ip": (".",), "phone": ("+",)}
CONTEXT = 48

# Further gazetteers, cue words.
TLDS = "com org net edu gov mil int info biz io co uk us ca au de fr es it nl be ch at se no dk fi pl pt ru jp cn in br mx eu".split()
DIAL_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92".split()
IBAN_COUNTRIES = "AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split()
CUES = {
    "email": r"e-?mail|contact|write|@|adresse|correo|kontakt|courriel",
    "ip": r"\bip\b|address|host|server|login|log in|from",
    "card": r"card|visa|master|amex|pay|credit|kredit|carte|tarjeta",
    "phone": r"phone|call|tel|mobile|fax|cell|telefon|appel|llam",
    "id": r"ssn|social|iban|account|passport|ident|konto|compte|cuenta",
    "secret": r"login|user|auth|credential|access",
    "person": r"signed|regards|dear|contact|born|lives|sincerely|called|phone|met|told|wrote",
}
DENIALS = r"version|isbn|issn|section|chapter|figure|order no|invoice|checksum|example only"
ROUNDS = 25
ADD_AT = 0.5


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def candidates(rows: DataFrame) -> DataFrame:
    """doc_id, kind (its number), start, end (code points), span, before, after.

    A text is split at a pattern's matches only if there are any; what stands
    between them gives the places, as running sums over the matches of a text.
    """
    text = F.col("text")
    places = F.transform(
        F.sequence(F.lit(0), F.size("_m") - 1),
        lambda i: F.struct(F.length(F.get("_p", i)).alias("gap"), F.right(F.get("_p", i), F.lit(CONTEXT)).alias("before"),
                           F.get("_m", i).alias("span"), F.left(F.get("_p", i + 1), F.lit(CONTEXT)).alias("after")))
    def matches(kind: str, pattern: str) -> Column:
        some = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in NEEDS.get(kind, ())], F.lit(kind not in NEEDS))
        return F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))

    out = rows.select("doc_id", "text", F.filter(
        F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(p).alias("pattern"), matches(name, p).alias("m"))
                  for k, (name, p) in enumerate(PATTERNS.items()))),
        lambda x: F.size(x["m"]) > 0).alias("found")).filter(F.size("found") > 0)
    out = out.select("doc_id", "text", F.explode("found").alias("f")).select(
        "doc_id", F.col("f.kind").alias("kind"), F.col("f.m").alias("_m"),
        F.expr("split(text, f.pattern, -1)").alias("_p"))
    out = out.select("doc_id", "kind", F.posexplode(places).alias("i", "x")).select("doc_id", "kind", "i", "x.*")
    upto = Window.partitionBy("doc_id", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("span")).over(upto)
    return out.select("doc_id", "kind", (end - F.length("span")).alias("start"), end.alias("end"), "span", "before", "after")


def _case(options: dict[str, Column], otherwise) -> Column:
    return F.coalesce(*(F.when(F.col("kind") == KINDS.index(k), v) for k, v in options.items()), F.lit(otherwise))


def valid_base(span: Column) -> dict[str, Column]:
    """Whether a match of a base kind stands."""
    n = F.length(_digits(span))
    return {
        "email": F.lit(True),
        "ip": F.forall(F.split(span, r"\."), lambda p: F.coalesce(p.try_cast("long") <= 255, F.lit(False))),
        "card": n.between(16, 19) & F.call_function("luhn_check", F.when(n.between(16, 19), _digits(span)).otherwise(F.lit("1"))),
        "phone": n.between(8, 15),
    }


def votes(spans: DataFrame) -> DataFrame:
    """``spans`` with the votes (1 yes, -1 no, 0 none) of three labelers: form
    (stricter patterns), list (gazetteers) and context (words around)."""
    s = F.col("span")
    yes_no = lambda c: F.when(c, 1).otherwise(-1)
    yes = lambda c: F.when(c, 1).otherwise(0)
    base = valid_base(s)
    form = _case({
        "email": yes_no(s.rlike(r"^[A-Za-z0-9].*@.*\.[A-Za-z]{2,24}$")), "ip": yes_no(base["ip"]),
        "card": yes_no(base["card"]), "phone": yes_no(base["phone"]),
        "id": yes_no(~s.rlike(r"^(?:000|666|9[0-9][0-9])-|-00-|-0000$")),
        "secret": yes_no(s.rlike("[0-9]") & s.rlike("[A-Za-z]")),
        "person": yes(s.rlike(r"\p{Ll}\x20\p{Lu}\p{Ll}{2,}"))}, 0)
    dialled = F.array(*(F.substring(_digits(s), 1, k) for k in (1, 2)))
    listed = _case({
        "email": yes(F.lower(F.regexp_extract(s, r"\.([A-Za-z0-9\-]+)$", 1)).isin(TLDS)),
        "ip": F.when(s.rlike(r"^0*(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-9])\."), -1).otherwise(1),
        "card": yes_no(_digits(s).rlike("^[3-6]")),
        "phone": yes(F.arrays_overlap(dialled, F.array(*map(F.lit, DIAL_CODES)))),
        "id": yes(F.substring(s, 1, 2).isin(IBAN_COUNTRIES)),
        "secret": yes(s.rlike(f"^(?:{'|'.join(KEY_MARKS)})")),
        "person": yes(F.lower(F.substring_index(s, " ", 1)).isin(FIRST_NAMES))}, 0)
    around = F.lower(F.concat_ws(" ", "before", "after"))
    titled = F.col("before").rlike(TITLES + r"\x20$")
    cue = _case({k: yes(around.rlike(p) | titled if k == "person" else around.rlike(p)) for k, p in CUES.items()}, 0)
    context = F.when(F.lower("before").rlike(DENIALS), -1).otherwise(cue)
    return spans.select("*", F.array(form, listed, context).alias("votes"))


def reliabilities(voted: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """kind, votes, p: the probability that a candidate with these votes is
    personal data, by expectation-maximisation.

    Votes given the truth are independent, with a distribution of its own for
    each kind and labeler; neither those nor the share of true candidates is
    known.  Whether a labeler votes at all tells nothing.  The corpus gives a count for each of the at most 27 vote patterns of
    a kind; the rounds work on these counts, one row per kind.
    """
    counts = voted.groupBy("kind", "votes").agg(F.count("*").cast("double").alias("n"))
    per = counts.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("pats"))

    def weight(cond: str, true: bool) -> str:
        p = "q" if true else "1D - q"
        return f"aggregate(zip_with(pats, post, (y, q) -> if({cond}, y.n * ({p}), 0D)), 0D, (s, v) -> s + v)"

    def joint(true: bool) -> str:
        terms = [f"if(x.votes[{j}] = 0, 1D, ({weight(f'y.votes[{j}] = x.votes[{j}]', true)} + 0.5D) / "
                 f"({weight(f'y.votes[{j}] <> 0', true)} + 1D))" for j in range(3)]
        return f"({weight('true', true)} + 1D) * " + " * ".join(terms)
    step = f"transform(pats, x -> {joint(True)} / ({joint(True)} + {joint(False)}))"
    start = "transform(pats, x -> 0.5D + 0.15D * aggregate(x.votes, 0, (s, v) -> s + v))"
    post = F.expr(f"aggregate(sequence(1, {rounds}), {start}, (post, round) -> {step})")
    solved = per.select("kind", F.explode(F.arrays_zip("pats", post.alias("p"))).alias("x"))
    return solved.select("kind", F.col("x.pats.votes").alias("votes"), F.col("x.p").alias("p"))


def span_features(span: Column, before: Column, after: Column) -> Column:
    """Form of a span and of what is next to it, as feature strings."""
    n = F.length(span)
    share = F.round(10 * F.length(_digits(span)) / F.greatest(n, F.lit(1)))
    return F.array(
        F.concat(F.lit("length:"), F.floor(F.log2(n + 1)).cast("string")),
        F.concat(F.lit("digits:"), share.cast("int").cast("string")),
        F.concat(F.lit("case:"), F.when(span.rlike(r"\p{Lu}"), "U").otherwise("-"), F.when(span.rlike(r"\p{Ll}"), "l").otherwise("-")),
        F.concat(F.lit("marks:"), F.least(F.length(F.regexp_replace(span, r"[\p{L}\p{N}]", "")), F.lit(6)).cast("string")),
        F.concat(F.lit("left:"), F.regexp_replace(F.regexp_replace(F.right(before, F.lit(1)), r"\p{L}", "a"), r"\p{N}", "9")),
        F.concat(F.lit("right:"), F.regexp_replace(F.regexp_replace(F.left(after, F.lit(1)), r"\p{L}", "a"), r"\p{N}", "9")))


def classify(voted: DataFrame) -> DataFrame:
    """``voted`` with ``p``, the final classifier's probability.

    Naive Bayes on the labelers' votes and the span's features, trained on all
    candidates with the probabilities of ``reliabilities`` as soft labels; its
    weights are one row per kind and feature value.
    """
    truth = reliabilities(voted)
    soft = voted.join(F.broadcast(truth), ["kind", "votes"])  # at most 27 rows a kind
    long = soft.select("doc_id", "kind", "start", "end", "p", F.explode(F.concat(
        "features", F.transform("votes", lambda v, i: F.concat_ws(":", F.lit("vote"), i.cast("string"), v.cast("string"))))).alias("f"))
    total = soft.groupBy("kind").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    weights = long.groupBy("kind", "f").agg(F.sum("p").alias("a"), F.sum(1 - F.col("p")).alias("b")).join(total, "kind").select(
        "kind", "f", F.log((F.col("a") + 0.5) / (F.col("yes") + 1) * (F.col("no") + 1) / (F.col("b") + 0.5)).alias("w"),
        F.log((F.col("yes") + 0.5) / (F.col("no") + 0.5)).alias("prior"))
    weights = hinted(table(weights, "weights"), 20_000)
    score = long.join(weights, ["kind", "f"]).groupBy("doc_id", "kind", "start", "end").agg(
        (F.sum("w") + F.max("prior")).alias("z"))
    return score.select("doc_id", "kind", "start", "end", (1 / (1 + F.exp(-F.greatest(F.least("z", F.lit(40)), F.lit(-40))))).alias("p"))


def personal_spans(docs: DataFrame, add_at: float = ADD_AT) -> DataFrame:
    """doc_id, kind, start, end, base, p of every span of personal data.

    Base spans (email, ip, card, phone: pattern and check) all stay; candidates
    of the other kinds (id numbers, secrets, persons) are added if the
    classifier gives them ``add_at`` at least.  Null and empty texts have none.
    """
    rows = one_per_id(docs, "doc_id", ["text"]).select("doc_id", whole_text().alias("text"))
    found = candidates(rows)
    base = _case({k: v for k, v in valid_base(F.col("span")).items()}, False)
    found = found.select("doc_id", "kind", "start", "end", "span", "before", "after", base.alias("base"))
    voted = table(votes(found).select(
        "doc_id", "kind", "start", "end", "base", "votes",
        span_features(F.col("span"), F.col("before"), F.col("after")).alias("features")), "candidates")
    judged = voted.select("doc_id", "kind", "start", "end", "base").join(classify(voted), ["doc_id", "kind", "start", "end"])
    extra = F.col("kind") >= len(BASE)
    return judged.filter(F.col("base") | (extra & (F.col("p") >= add_at)))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, n_id, n_secret,
    n_person, base (array of kind:start:end of base spans), spans (of all spans),
    by kind, then start.

    Rows without an id are left out, rows that repeat one count once; texts
    without spans, null and empty ones included, have empty arrays; an empty
    table gives no rows.
    """
    spans = table(personal_spans(docs), "spans")
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    spans = spans.withColumn("said", F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string")))
    listed = lambda c: F.transform(F.sort_array(F.collect_list(c)), lambda x: x["said"])
    item = F.struct("kind", "start", "said")
    per = spans.groupBy("doc_id").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{b}") for k, b in enumerate(KINDS)),
        listed(F.when(F.col("base"), item)).alias("base"), listed(item).alias("spans"))
    ids = one_per_id(docs.select("doc_id"), "doc_id", [])
    none = F.array().cast("array<string>")
    return ids.join(per, "doc_id", "left").select(
        "doc_id", *(F.coalesce(f"n_{b}", F.lit(0).cast("long")).alias(f"n_{b}") for b in KINDS),
        F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))
