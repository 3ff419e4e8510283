"""Views over the driver tables, built the same way in Spark and in DuckDB SQL.

The driver tables hold no crash data, so these views derive case, vehicle,
prediction and answer tables from them with :func:`hash32`.  Each view has a
Spark builder (``Views.<name>``) and an SQL fragment (``VIEW_SQL[name]``);
:func:`with_views` prefixes an oracle query with the fragments it needs.
All views grow linearly with their source table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.codes import MANCOLL_CODES
from tallyspark.functions.hashing import hash32, pick, sql_hash32, sql_pick
from tallyspark.operators.relate import first_per_key
from tallyspark.session import dealt, scratch_path, spread

# (model, error percent); every model has runs 1..3.
MODELS = [("m1", 10), ("m2", 20), ("m3", 30)]
RUNS = [1, 2, 3]
CONF_LETTERS = "ABCDEFGHIJKLMZ"  # Z is not in the configuration codebook
CODEBOOK_LETTERS = "ABCDEFGHIJKLM"
NARR_LEAD = ("Vehicle 1 was northbound when V2 struck Vehicle #1. "
             "vehicle 3 and V#4 stopped; V10 left. ")
# Answer shapes of the response view; d = one digit, nn = two digits.
ANSWER_SHAPES = ["The answer is {d}.", "{nn}", "class B", "Angle {d}", "", "unknown"]
# Bytes of orders whose samples, and the counts of their predictions, one task holds.
ORDERS_TASK_BYTES = 1 << 20
GV_ORDER = ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def _vehicles(key) -> F.Column:
    return (F.when(hash32(key, "veh0") % 97 == 0, F.lit(0))
            .otherwise(1 + hash32(key, "veh") % 4)).cast("int")


def _sql_vehicles(k: str) -> str:
    return (f"CAST(CASE WHEN {sql_hash32(k, "'veh0'")} % 97 = 0 THEN 0 "
            f"ELSE 1 + {sql_hash32(k, "'veh'")} % 4 END AS INTEGER)")


def _code7(key, salt) -> F.Column:
    return pick(hash32(key, salt), MANCOLL_CODES).cast("int")


def _sql_code7(k: str, salt_sql: str) -> str:
    return f"CAST({sql_pick(sql_hash32(k, salt_sql), MANCOLL_CODES)} AS INTEGER)"


class Views:
    """Lazily built Spark views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str, spread_rows: bool = True) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(df) if spread_rows else df

    # -- predictions: one row per (sample, model, run) -------------------------
    @cached_property
    def pred_long(self) -> DataFrame:
        grid = F.inline(F.array(*[
            F.struct(F.lit(m).alias("model"), F.lit(r).alias("run"), F.lit(e).alias("err"))
            for m, e in MODELS for r in RUNS]))
        # The truth label is per sample: derive it before the 9x fan-out.
        orders = dealt(self.table("orders", spread_rows=False), "o_orderkey", ORDERS_TASK_BYTES)
        per_sample = orders.select(F.col("o_orderkey").alias("sid"), _code7("o_orderkey", "gt").alias("gt"))
        base = per_sample.select("sid", "gt", grid)
        tag = F.concat(F.col("model"), F.col("run").cast("string"))
        pred = F.when(hash32("sid", F.concat(F.lit("e"), tag)) % 100 < F.col("err"),
                      pick(hash32("sid", F.concat(F.lit("p"), tag)), MANCOLL_CODES)
                      ).otherwise(F.col("gt")).cast("int")
        # No vote: every run of some samples, and some single runs; m3 has no run 3.
        no_vote = (F.col("sid") % 37 == 0) | (hash32("sid", F.concat(F.lit("n"), tag)) % 40 == 0)
        return (base.where(hash32("sid", F.concat(F.lit("d"), tag)) % 50 != 0)
                .where("not (model = 'm3' and run = 3)")
                .select("sid", "model", F.col("run").cast("int").alias("run"), "gt",
                        F.when(~no_vote, pred).alias("pred")))

    @cached_property
    def pred_text(self) -> DataFrame:
        """Predictions exported as text in mixed shapes (' 5 ', '5.0', '5')."""
        p = self.pred_long
        shape = hash32(F.concat_ws("-", "sid", "model", F.col("run").cast("string")), "fmt") % 4
        txt = F.col("pred").cast("string")
        raw = (F.when(shape == 0, txt).when(shape == 1, F.concat(txt, F.lit(".0")))
               .when(shape == 2, F.concat(F.lit(" "), txt, F.lit(" "))).otherwise(F.concat(txt, F.lit(".00"))))
        return p.select("sid", "model", "run", F.col("gt").cast("string").alias("gt_raw"),
                        raw.alias("pred_raw"))

    # -- cases and vehicles -----------------------------------------------------
    @cached_property
    def cases(self) -> DataFrame:
        o = self.table("orders")
        return o.select(
            F.col("o_orderkey").alias("caseid"),
            F.concat(F.lit("Case "), F.col("o_orderkey").cast("string"), F.lit(": "),
                     F.col("o_orderpriority"), F.lit(", status "), F.col("o_orderstatus")).alias("summary"),
            _vehicles("o_orderkey").alias("vehicles"),
            _code7("o_orderkey", "gt").alias("mancoll"))

    @cached_property
    def cases_dup(self) -> DataFrame:
        """Cases of which some have a second row with other values."""
        c = self.cases
        again = c.where(F.col("caseid") % 29 == 0).select(
            "caseid", F.concat(F.lit("Second row of "), "summary").alias("summary"),
            (F.col("vehicles") + 1).alias("vehicles"), "mancoll")
        return c.unionByName(again)

    @cached_property
    def gv_raw(self) -> DataFrame:
        """Vehicle labels with duplicate keys and the declared order columns."""
        li = self.table("lineitem")
        k = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                        F.col("l_partkey").cast("string"))
        # each hash once a row: a column of its own, not repeated in every branch that reads it
        li = li.select("l_orderkey", "l_linenumber", *GV_ORDER, (hash32(k, "cat") % 20).alias("_x"),
                       (hash32(k, "conf") % 14).alias("_conf"))
        x, conf_idx = F.col("_x"), F.col("_conf")
        return li.select(
            F.col("l_orderkey").alias("caseid"),
            F.col("l_linenumber").cast("int").alias("vehno"),
            F.when(x == 0, F.lit(None)).when(x == 1, F.lit(9)).otherwise(1 + x % 6).cast("int").alias("crashcat"),
            F.substring(F.lit(CONF_LETTERS), (conf_idx + 1).cast("int"), 1).alias("crashconf"),
            # some vehicles, and all of some cases, have no type label
            F.when((hash32(k, "tnull") % 30 != 0) & (F.col("l_orderkey") % 41 != 0),
                   7 * conf_idx + hash32(k, "type") % 7).cast("int").alias("crashtype"),
            *GV_ORDER)

    @cached_property
    def _gv_first(self) -> DataFrame:
        """Deduped vehicles plus the prediction view's per-key hashes.

        The hashes depend on the key only; carrying them through the same
        aggregate lets truth and predictions share one aggregation (its
        exchange is reused) instead of Spark pushing the prediction filter
        below the aggregate and deriving the truth twice.
        """
        c = F.concat_ws("-", F.col("caseid").cast("string"), F.col("vehno").cast("string"))
        raw = (self.gv_raw.withColumn("_pd", hash32(c, "pd") % 20).withColumn("_pe", hash32(c, "pe") % 10)
               .withColumn("_pp", hash32(c, "pp") % 25))
        return first_per_key(raw, ["caseid", "vehno"], GV_ORDER,
                             ["crashcat", "crashconf", "crashtype", "_pd", "_pe", "_pp"])

    def kept_vehicles(self) -> Views:
        """These views with the deduped vehicles written once: for queries of
        several jobs (or range partitionings, which read their input twice),
        each of which would derive them again."""
        path = scratch_path(self.spark, "vehicles")
        self._gv_first.write.parquet(path)
        self.__dict__["_gv_first"] = self.spark.read.parquet(path)
        return self

    @cached_property
    def gv(self) -> DataFrame:
        """First vehicle row per (caseid, vehno) in the declared order."""
        return self._gv_first.select("caseid", "vehno", "crashcat", "crashconf", "crashtype")

    @cached_property
    def vpred(self) -> DataFrame:
        own = F.when(F.col("_pe") == 9, None).when(F.col("_pe") < 3, (F.col("crashtype") + 1) % 98).otherwise(F.col("crashtype"))

        def row(cat, conf, kind):
            return F.struct(cat.cast("int").alias("crashcat"), conf.alias("crashconf"), kind.cast("int").alias("crashtype"))
        one = row(F.col("crashcat"), F.col("crashconf"), own)
        # a second, different prediction for some keys
        other = row((F.coalesce("crashcat", F.lit(0)) + 5) % 7, F.lit("B"), (F.coalesce("crashtype", F.lit(0)) + 2) % 98)
        rows = F.when(F.col("_pp") == 0, F.array(one, other)).otherwise(F.array(one))
        kept = self._gv_first.where(F.col("_pd") != 0).select("caseid", "vehno", F.inline(rows))
        # One extra (wrong) vehicle for every order key divisible by 50.
        extra = (self.table("orders", spread_rows=False).where(F.col("o_orderkey") % 50 == 0)
                 .select(F.col("o_orderkey").alias("caseid"), F.lit(99).alias("vehno"), F.lit(1).alias("crashcat"),
                         F.lit("A").alias("crashconf"), F.lit(1).alias("crashtype")))
        return kept.unionByName(extra)

    @cached_property
    def codebook(self) -> DataFrame:
        """Configuration codebook: letter -> crash-type code offset (bounded, 13 rows)."""
        rows = [(ch, 7 * i) for i, ch in enumerate(CODEBOOK_LETTERS)]
        return self.spark.createDataFrame(rows, "conf string, code_offset int")

    # -- text -------------------------------------------------------------------
    @cached_property
    def narr(self) -> DataFrame:
        d = self.table("documents")
        return d.select(F.col("doc_id").alias("caseid"), _vehicles("doc_id").alias("vehicles"),
                        F.concat(F.lit(NARR_LEAD), F.col("text")).alias("summary"),
                        _code7("doc_id", "gt").alias("mancoll"))

    @cached_property
    def resp(self) -> DataFrame:
        e = self.table("events")
        v = hash32("event_id", "v")
        d = (v % 10).cast("string")
        nn = (v % 90 + 10).cast("string")
        shape = hash32("event_id", "r") % 6
        answer = F.lit("")
        for i, s in reversed(list(enumerate(ANSWER_SHAPES))):
            expr = F.lit(s)
            if "{d}" in s:
                a, b = s.split("{d}")
                expr = F.concat(F.lit(a), d, F.lit(b))
            elif "{nn}" in s:
                expr = nn
            answer = F.when(shape == i, expr).otherwise(answer)
        return e.select(F.col("event_id").alias("id"), answer.alias("answer"))

    @cached_property
    def emb(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", "embedding", "label")

    @cached_property
    def docs(self) -> DataFrame:
        return self.table("documents").select("doc_id", "text", "lang")


# ---------------------------------------------------------------------------
# SQL (DuckDB) text of the same views.
# ---------------------------------------------------------------------------

def _models_values() -> str:
    return ", ".join(f"('{m}', {r}, {e})" for m, e in MODELS for r in RUNS)


_H = sql_hash32

VIEW_SQL: dict[str, tuple[list[str], str]] = {}

VIEW_SQL["pred_long"] = ([], f"""
SELECT sid, model, run, gt,
       CAST(CASE WHEN sid % 37 = 0 OR {_H('sid', "'n' || tag")} % 40 = 0 THEN NULL
            WHEN {_H('sid', "'e' || tag")} % 100 < err
            THEN {sql_pick(_H('sid', "'p' || tag"), MANCOLL_CODES)} ELSE gt END AS INTEGER) AS pred
FROM (SELECT o.o_orderkey AS sid, g.model, CAST(g.run AS INTEGER) AS run, g.err,
             g.model || CAST(g.run AS VARCHAR) AS tag, {_sql_code7('o.o_orderkey', "'gt'")} AS gt
      FROM orders o CROSS JOIN (VALUES {_models_values()}) g(model, run, err)) b
WHERE {_H('sid', "'d' || tag")} % 50 <> 0 AND NOT (model = 'm3' AND run = 3)""")

VIEW_SQL["pred_text"] = (["pred_long"], f"""
SELECT sid, model, run, CAST(gt AS VARCHAR) AS gt_raw,
       CASE {_H("CAST(sid AS VARCHAR) || '-' || model || '-' || CAST(run AS VARCHAR)", "'fmt'")} % 4
         WHEN 0 THEN CAST(pred AS VARCHAR) WHEN 1 THEN CAST(pred AS VARCHAR) || '.0'
         WHEN 2 THEN ' ' || CAST(pred AS VARCHAR) || ' ' ELSE CAST(pred AS VARCHAR) || '.00' END AS pred_raw
FROM pred_long""")

VIEW_SQL["cases"] = ([], f"""
SELECT o_orderkey AS caseid,
       'Case ' || CAST(o_orderkey AS VARCHAR) || ': ' || o_orderpriority || ', status ' || o_orderstatus AS summary,
       {_sql_vehicles('o_orderkey')} AS vehicles,
       {_sql_code7('o_orderkey', "'gt'")} AS mancoll
FROM orders""")

_GVK = "CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR)"
VIEW_SQL["gv_raw"] = ([], f"""
SELECT l_orderkey AS caseid, CAST(l_linenumber AS INTEGER) AS vehno,
       CAST(CASE {_H(_GVK, "'cat'")} % 20 WHEN 0 THEN NULL WHEN 1 THEN 9
            ELSE 1 + ({_H(_GVK, "'cat'")} % 20) % 6 END AS INTEGER) AS crashcat,
       substr('{CONF_LETTERS}', CAST({_H(_GVK, "'conf'")} % 14 + 1 AS INTEGER), 1) AS crashconf,
       CAST(CASE WHEN {_H(_GVK, "'tnull'")} % 30 <> 0 AND l_orderkey % 41 <> 0 THEN
            7 * ({_H(_GVK, "'conf'")} % 14) + {_H(_GVK, "'type'")} % 7 END AS INTEGER) AS crashtype,
       {", ".join(GV_ORDER)}
FROM lineitem""")

VIEW_SQL["gv"] = (["gv_raw"], f"""
SELECT caseid, vehno, crashcat, crashconf, crashtype FROM (
  SELECT *, row_number() OVER (PARTITION BY caseid, vehno
         ORDER BY {", ".join(GV_ORDER)}, crashcat, crashconf, crashtype) AS rn_
  FROM gv_raw) WHERE rn_ = 1""")

_VC = "CAST(caseid AS VARCHAR) || '-' || CAST(vehno AS VARCHAR)"
VIEW_SQL["vpred"] = (["gv"], f"""
SELECT caseid, vehno, crashcat, crashconf,
       CAST(CASE WHEN {_H(_VC, "'pe'")} % 10 = 9 THEN NULL WHEN {_H(_VC, "'pe'")} % 10 < 3 THEN (crashtype + 1) % 98
            ELSE crashtype END AS INTEGER) AS crashtype
FROM gv WHERE {_H(_VC, "'pd'")} % 20 <> 0
UNION ALL
SELECT caseid, vehno, CAST((coalesce(crashcat, 0) + 5) % 7 AS INTEGER), 'B', CAST((coalesce(crashtype, 0) + 2) % 98 AS INTEGER)
FROM gv WHERE {_H(_VC, "'pd'")} % 20 <> 0 AND {_H(_VC, "'pp'")} % 25 = 0
UNION ALL
SELECT o_orderkey AS caseid, 99 AS vehno, 1 AS crashcat, 'A' AS crashconf, 1 AS crashtype
FROM orders WHERE o_orderkey % 50 = 0""")

# The prediction that counts for a key: the first by its values, null first.
VIEW_SQL["vp1"] = (["vpred"], """
SELECT caseid, vehno, crashcat, crashconf, crashtype FROM (
  SELECT *, row_number() OVER (PARTITION BY caseid, vehno ORDER BY crashcat NULLS FIRST, crashconf NULLS FIRST,
         crashtype NULLS FIRST) AS rn_ FROM vpred) WHERE rn_ = 1""")

VIEW_SQL["cases_dup"] = (["cases"], """
SELECT caseid, summary, vehicles, mancoll FROM cases
UNION ALL SELECT caseid, 'Second row of ' || summary, vehicles + 1, mancoll FROM cases WHERE caseid % 29 = 0""")

VIEW_SQL["codebook"] = ([], "SELECT * FROM (VALUES " + ", ".join(
    f"('{ch}', {7 * i})" for i, ch in enumerate(CODEBOOK_LETTERS)) + ") t(conf, code_offset)")

VIEW_SQL["narr"] = ([], f"""
SELECT doc_id AS caseid, {_sql_vehicles('doc_id')} AS vehicles,
       '{NARR_LEAD}' || text AS summary, {_sql_code7('doc_id', "'gt'")} AS mancoll
FROM documents""")


def _resp_sql() -> str:
    v = _H("event_id", "'v'")
    parts = []
    for i, s in enumerate(ANSWER_SHAPES):
        if "{d}" in s:
            a, b = s.split("{d}")
            e = f"'{a}' || CAST({v} % 10 AS VARCHAR) || '{b}'"
        elif "{nn}" in s:
            e = f"CAST({v} % 90 + 10 AS VARCHAR)"
        else:
            e = f"'{s}'"
        parts.append(f"WHEN {i} THEN {e}")
    return (f"SELECT event_id AS id, CASE {_H('event_id', "'r'")} % 6 {' '.join(parts)} ELSE '' END AS answer "
            f"FROM events")


VIEW_SQL["resp"] = ([], _resp_sql())
VIEW_SQL["emb"] = ([], "SELECT vec_id, embedding, label FROM embeddings")
VIEW_SQL["docs"] = ([], "SELECT doc_id, text, lang FROM documents")


def with_views(names: list[str] | str, body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` the named views (and their dependencies), then ``body``.

    ``extra`` appends further (name, sql) CTEs after the views.
    """
    if isinstance(names, str):
        names = [names]
    order: list[str] = []

    def visit(n: str):
        if n in order:
            return
        for d in VIEW_SQL[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    ctes = [f"{n} AS ({VIEW_SQL[n][1]}\n)" for n in order]
    ctes += [f"{n} AS ({s}\n)" for n, s in (extra or [])]
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body
