"""Secret scans with multipart linking, in Spark SQL alone.

Strong parts are reported wherever they are: ``assign`` (a value assigned to a
password-like name), ``access`` (a cloud access id), ``hex`` (a long run of hex
digits). Weak parts mean little alone: ``ident`` (a user, client or account
assigned a value), ``opaque`` (a mixed run of 32 or more letters and digits),
``endpoint`` (an URL or an IPv4 address). They are reported only when what
completes a credential is no more than ``SCOPE`` characters away, from the end
of the one part to the start of the other: an identifier for a secret, a secret
for an identifier, both for an endpoint.

The interval join is a sweep over a text's parts in order of their starts: what
comes before a part is near when the greatest end of its role is, what comes
after when the least start is. That is exact, and linear after the sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkglass.functions.text import let
from inkglass.session import scratch_dir, stored

SCOPE = 200
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENT = r"""(?i)(?:user(?:name)?|login|client_?id|account(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]+"""
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[A-Z0-9+/_-]*+[a-z])(?=[a-z0-9+/_-]*+[A-Z])[A-Za-z0-9+/_-]{32,}"
ENDPOINT = r"""https?://[^\x00-\x20"'<>()]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])"""
#: A text without a match of this has no part.
ANY = r"(?i)password|passwd|secret|token|api_?key|akia|[0-9a-f]{24}|user|login|client|account|https?://|[0-9]\.[0-9]|[a-z0-9+/_-]{32}"
#: Kind, pattern, group whose length is bounded, least length; in the order of ties.
STRONG = [("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24)]
WEAK = [("ident", IDENT, 0, 1), ("opaque", OPAQUE, 0, 32), ("endpoint", ENDPOINT, 0, 1)]
KINDS = [k for k, *_ in STRONG + WEAK]
SPAN = "array<struct<s:bigint,k:int,e:bigint>>"
AT_ONCE = 256  # matches whose places are added up together


def spans(text, rank: int, pattern: str, group: int, least: int):
    """Places of all matches, leftmost first, none overlapping: what lies
    between the matches and the matches themselves add up to them."""
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    each = F.arrays_zip(F.slice(between, 1, F.size(hits)).alias("b"), hits.alias("h"), values.alias("v"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))

    def add(acc, x):
        s = acc["at"] + F.length(x["b"])
        e = s + F.length(x["h"])
        one = F.array(F.struct(s.alias("s"), F.lit(rank).alias("k"), e.alias("e")))
        return F.struct(e.alias("at"), F.when(F.length(x["v"]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    # places within blocks of matches, then the blocks' own places: a list that grows is copied for each match
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def placed(blocks):
        starts = F.aggregate(blocks, none, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        moved = F.zip_with(blocks, starts, lambda x, at: F.transform(x["out"], lambda y: F.struct((y["s"] + at).alias("s"), y["k"].alias("k"), (y["e"] + at).alias("e"))))
        return F.flatten(moved)

    def blocks(each):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(each) - 1) / AT_ONCE).cast("int")), lambda k: F.aggregate(F.slice(each, k * AT_ONCE + 1, AT_ONCE), zero, add))

    return let(each, lambda x: F.when(F.size(x) > AT_ONCE, let(blocks(x), placed)).otherwise(F.aggregate(x, zero, add)["out"]))


def _found(text, kinds, first: int):
    none = F.array().cast(SPAN)
    each = [F.when(F.regexp_like(text, F.lit(p)), spans(text, first + i, p, g, n)).otherwise(none) for i, (_, p, g, n) in enumerate(kinds)]
    return F.when(F.regexp_like(text, F.lit(ANY)), F.array_sort(F.concat(*each))).otherwise(none)


def _names(a):
    return F.concat_ws(",", F.transform(a, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))))


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row.

    Offsets are code points, ends exclusive. Null texts count as empty, which
    have no spans. Rows that repeat a doc_id are scanned each on its own text.
    Kinds of one start stand in the order assign, access, hex, ident, opaque,
    endpoint. A weak part that overlaps a strong one is not reported.
    """
    where = scratch_dir(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("|"), F.col("text"))).alias("row"), _found(F.col("text"), STRONG, 0).alias("base"), _found(F.col("text"), WEAK, len(STRONG)).alias("weak"))
    rows = stored(rows, where, "parts")
    some = rows.where(F.size("weak") > 0).where((F.size("base") + F.size("weak")) > 1).dropDuplicates(["row"])
    parts = some.select("row", F.explode(F.concat("base", "weak")).alias("p")).select("row", "p.*")
    strong = F.col("k") < len(STRONG)
    up = Window.partitionBy("row").orderBy("s", "k", "e").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("row").orderBy(F.desc("s"), F.desc("k"), F.desc("e")).rowsBetween(Window.unboundedPreceding, -1)
    low, high = F.lit(-SCOPE - 1), F.lit(2**62)

    def around(of, name: str):
        """The greatest end of such parts before a part, the least start after it."""
        return {f"{name}_before": F.coalesce(F.max(F.when(of, F.col("e"))).over(up), low), f"{name}_after": F.coalesce(F.min(F.when(of, F.col("s"))).over(down), high)}

    parts = parts.withColumns(around(strong, "strong"))
    parts = parts.where(strong | ((F.col("strong_before") <= F.col("s")) & (F.col("strong_after") >= F.col("e"))))
    ids, endpoint = F.col("k").isin(KINDS.index("access"), KINDS.index("ident")), F.col("k") == KINDS.index("endpoint")
    parts = parts.withColumns(around(ids, "id") | around(~ids & ~endpoint, "secret"))
    near = {n: (F.col(f"{n}_before") >= F.col("s") - SCOPE) | (F.col(f"{n}_after") <= F.col("e") + SCOPE) for n in ("id", "secret")}
    whole = F.when(F.col("k") == KINDS.index("ident"), near["secret"]).when(F.col("k") == KINDS.index("opaque"), near["id"]).otherwise(near["id"] & near["secret"])
    linked = parts.where(~strong & whole).groupBy("row").agg(F.collect_list(F.struct("s", "k", "e")).alias("linked"))
    out = rows.join(linked, "row", "left").withColumn("all", F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(SPAN)))))

    def count(rank: int):
        return F.size(F.filter("base", lambda x: x["k"] == rank)).cast("long")

    n = [count(i).alias(f"n_{k}") for i, (k, *_) in enumerate(STRONG)]
    return out.select("doc_id", *n, F.sha2(_names(F.col("base")), 256).alias("base_sha256"), _names(F.col("all")).alias("spans"))
