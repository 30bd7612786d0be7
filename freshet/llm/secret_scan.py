"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong secrets are found by pattern alone. Weak parts (short secrets, key identifiers, endpoints) say
little by themselves; an interval join within each document links identifiers, secrets and endpoints
that stand close together, and only linked weak parts are reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import common as C
from freshet.llm.spans import joined, labelled, matches

# The patterns of the contract.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA[A-Z0-9]+ of 18 or more characters: no shorter run holds a longer one
HEX = r"[0-9a-f]{16,}"  # runs of 16 or more, likewise

# Weak parts: (kind, part, pattern)
WEAK = [
    ("weak_id", "id", r"(?:(?i:access_?key(?:_?id)?|client_?id|account_?id))[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{4,}|(?:ASIA|AROA|AIDA)[A-Z0-9]{12,}"),
    ("endpoint", "endpoint", r"(?i:https?|ftp|s3|jdbc:[a-z]{2,12}|mysql|postgres(?:ql)?|mongodb|redis|amqp)://[^\s\"'<>]{4,}"),
]
SCOPE = 400


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    spans: kind:start:end in code points, ordered by start and kind; it holds all strong spans, and
    those of weak parts (weak_id, weak_secret, endpoint) that have a complementary part whose start is
    within `scope` code points: an identifier a secret, a secret an identifier or endpoint, an endpoint
    a secret. Null and empty texts have no spans. Rows without
    an id, of one id or equal in all are rows of their own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    assign = matches(text, ASSIGN)
    rows = rows.select(
        "id",
        assign.alias("assign"),
        matches(text, ACCESS, F.contains(text, F.lit("AKIA"))).alias("access"),
        matches(text, HEX).alias("hex"),
        *[matches(text, p).alias(kind) for kind, _, p in WEAK],
    )
    long = lambda x: F.length(F.regexp_extract(x["t"], ASSIGN, 2)) >= 12
    rows = rows.withColumn("weak_secret", F.filter("assign", lambda x: ~long(x))).withColumn("assign", F.filter("assign", long))
    base = F.array_sort(F.concat(labelled(F.col("assign"), "assign", 0), labelled(F.col("access"), "access", 1), labelled(F.col("hex"), "hex", 2)))
    weak = F.concat(*[labelled(F.col(k), k, r) for r, k in ((3, "weak_id"), (4, "weak_secret"), (5, "endpoint"))])
    rows = rows.select("id", F.size("assign").alias("n_assign"), F.size("access").alias("n_access"), F.size("hex").alias("n_hex"), base.alias("base"), weak.alias("weak"))
    # numbers stand for rows in all that follows, so copies of one text meet in no task
    rows = C.checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))

    # every part of a row with weak parts
    part = F.when(F.col("x.kind").isin("access", "weak_id"), "id").when(F.col("x.kind") == "endpoint", "endpoint").otherwise("secret")
    parts = rows.where(F.size("weak") > 0).select("row", F.explode(F.concat("base", "weak")).alias("x"))
    parts = parts.select("row", "x", part.alias("part"), F.floor(F.col("x.s") / scope).alias("cell"))
    near = parts.select("row", F.col("x.s").alias("at"), F.col("part").alias("other"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    fits = ((F.col("part") == "secret") & (F.col("other") != "secret")) | ((F.col("part") != "secret") & (F.col("other") == "secret"))
    close = F.abs(F.col("x.s") - F.col("at")) <= scope
    linked = parts.where(F.col("x.r") >= 3).join(near, ["row", "cell"]).where(fits & close).select("row", "x").distinct()
    added = linked.groupBy("row").agg(F.collect_list("x").alias("added"))
    out = rows.join(added, "row", "left").withColumn("added", F.coalesce("added", F.array().cast("array<struct<s:int,r:int,e:int,kind:string>>")))
    return out.select(
        F.col("id").alias(id_col),
        *[F.col(c).cast("long").alias(c) for c in ("n_assign", "n_access", "n_hex")],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_linked"),
    )
