from tallyspark.functions.hashing import hash32, pick, sql_hash32, sql_pick

__all__ = ["hash32", "pick", "sql_hash32", "sql_pick"]
