"""References against candidate records: identity, scores, status, ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkglass.functions import arrow
from inkglass.functions import text as T

# Thresholds, weights, work types, provider order.
VERIFIED, PARTIAL, STRONG = 70, 50, 80
MAX_AGE = 25
PRIMARY = ["research-article", "original-research", "clinical-trial", "randomized-controlled-trial", "research-output"]
SECONDARY = [
    "review", "editorial", "letter", "commentary", "erratum", "retraction", "book-review", "supplementary-materials", "meta-analysis", "systematic-review",
]
PROVIDERS = ["crossref", "openalex", "semantic_scholar", "arxiv"]
AUTHOR_COUNT = "\\b[A-Z][A-Za-z'-]+(?=,\\s*[A-Z]\\.?|\\s*&|\\s+and\\b)"


def identity(doi: Column, arxiv: Column, title: Column, year: Column, arxiv_first: bool = False) -> Column:
    d = F.concat(F.lit("doi:"), T.normalize_doi(doi))
    a = F.concat(F.lit("arxiv:"), T.normalize_arxiv(arxiv))
    rest = F.concat(F.lit("title:"), T.normalize_title(title), F.lit("|"), F.coalesce(year.cast("string"), F.lit("")))
    return F.coalesce(a, d, rest) if arxiv_first else F.coalesce(d, a, rest)


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """Records of one work made one, over (query_id, arrival, title, authors,
    year, venue, doi, arxiv_id, abstract, source_api): the first that has a
    field gives it, but the longest abstract and author list win."""
    key = identity(F.col("doi"), F.col("arxiv_id"), F.col("title"), F.col("year"), arxiv_first=True)
    rows = candidates.withColumn("identity", key)

    def first(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("arrival"))).alias(c)

    def longest(c: str, n: Column) -> Column:
        return F.max_by(c, F.struct(n, -F.col("arrival"))).alias(c)

    out = rows.groupBy("query_id", "identity").agg(
        F.min("arrival").alias("arrival"), *(first(c) for c in ("title", "year", "venue", "doi", "arxiv_id")),
        longest("abstract", F.coalesce(F.length("abstract"), F.lit(0))), longest("authors", F.coalesce(F.size("authors"), F.lit(0))),
        F.array_sort(F.collect_list(F.struct("arrival", "source_api"))).alias("_apis"),
    )
    return out.withColumn("source_apis", F.array_distinct(F.transform("_apis", lambda x: x["source_api"]))).drop("_apis")


def relevance(query: Column, title: Column, doi: Column, arxiv: Column, sequence: Column | None = None) -> Column:
    """0 to 100: equal ids are 100; else .65 share of the query's words and .35
    matching sequence."""
    q, t = T.normalize_title(query), T.normalize_title(title)
    words = F.array_distinct(T.tokens_by_space(q))
    share = F.size(F.array_intersect(words, F.array_distinct(T.tokens_by_space(t)))) / F.greatest(F.size(words), F.lit(1))
    ratio = arrow.sequence_ratio(q, t) if sequence is None else sequence
    same = T.normalize_doi(query).eqNullSafe(T.normalize_doi(doi)) & T.normalize_doi(query).isNotNull()
    same_arxiv = T.normalize_arxiv(query).eqNullSafe(T.normalize_arxiv(arxiv)) & T.normalize_arxiv(query).isNotNull()
    return F.when(same | same_arxiv, 100).when((q == "") | (t == ""), 0).otherwise(T.half_even((share * 0.65 + ratio * 0.35) * 100)).cast("long")


def ranked(candidates: DataFrame) -> DataFrame:
    """Candidates of each query by relevance, year, title, arXiv id, provider, DOI."""
    provider = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PROVIDERS)), F.col("source_api")), F.lit(0)), F.lit(len(PROVIDERS) + 1))
    order = [
        F.col("relevance").desc(), F.coalesce("year", F.lit(0)).desc(), T.normalize_title(F.col("title")), F.col("arxiv_id").isNotNull().desc(), provider,
        F.coalesce(T.normalize_doi(F.col("doi")), F.lit("")), F.col("arrival"),
    ]
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))


def strong_match(query: Column, title: Column, doi: Column, arxiv: Column, sequence: Column | None = None) -> Column:
    """Whether a record is the one asked for: of an equal id, or of an equal
    title and relevance of ``STRONG`` or more."""

    def same(f: Callable[[Column], Column], c: Column) -> Column:
        return F.coalesce(f(query) == f(c), F.lit(False))

    alike = same(T.normalize_title, title) & (relevance(query, title, doi, arxiv, sequence) >= STRONG)
    return same(T.normalize_doi, doi) | same(T.normalize_arxiv, arxiv) | alike


def title_similarity(a: Column, b: Column, sequence: Column | None = None) -> Column:
    """0 to 100: .55 shared words of all words, .45 matching sequence of the
    titles' normal forms; null without words on either side."""
    x, y = T.normalize_title(F.coalesce(a, F.lit(""))), T.normalize_title(F.coalesce(b, F.lit("")))
    ratio = arrow.sequence_ratio(x, y) if sequence is None else sequence
    shared = T.jaccard(F.array_distinct(T.tokens_by_space(x)), F.array_distinct(T.tokens_by_space(y)))
    return F.when((x != "") & (y != ""), T.half_even((shared * 0.55 + ratio * 0.45) * 100)).cast("long")


def best_reference(scored: DataFrame) -> DataFrame:
    """The candidate of each entry with the highest ``overall``, then the first
    title in normal form, then the first to arrive; one aggregate, no sort."""
    key = F.struct(-F.col("overall"), T.normalize_title(F.coalesce("title", F.lit(""))), F.col("arrival"))
    return scored.groupBy("entry_id").agg(F.min_by(F.struct(*(c for c in scored.columns if c != "entry_id")), key).alias("best")).select("entry_id", "best.*")


def author_score(entry_authors: Column, surnames: Column) -> Column:
    """Share of a record's surnames that the entry names, accents folded."""
    names = T.plain_tokens(entry_authors)
    n = F.size(F.filter(surnames, lambda s: F.array_contains(names, s)))
    whole = F.greatest(F.size(surnames), F.regexp_count(entry_authors, F.lit(AUTHOR_COUNT)), F.lit(1))
    return F.when((F.coalesce(entry_authors, F.lit("")) != "") & (F.size(names) > 0) & (F.size(surnames) > 0), T.half_even(n / whole * 100))


def surnames(authors: Column) -> Column:
    """The last word of each name, accents folded, each once."""
    last = F.transform(authors, lambda a: T.let(T.plain_tokens(a), lambda w: F.get(w, F.size(w) - 1)))
    return F.array_distinct(F.filter(last, lambda x: x.isNotNull()))


def year_score(no_date: Column, entry_year: Column, year: Column) -> Column:
    return F.when(~F.coalesce(no_date, F.lit(False)) & entry_year.isNotNull() & year.isNotNull(), F.when(entry_year == year, 100).otherwise(0)).cast("long")


def doi_score(entry_doi: Column, doi: Column) -> Column:
    a, b = T.normalize_doi(entry_doi), T.normalize_doi(doi)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, 100).otherwise(0)).cast("long")


def overall(title: Column, author: Column, year: Column, doi: Column) -> Column:
    """The weighted mean of the scores there are. A DOI, where both have one,
    weighs most; an unequal one caps the whole at 49."""

    def mean(parts: list[tuple[Column, int]]) -> Column:
        total = sum((F.coalesce(s, F.lit(0)) * w for s, w in parts), F.lit(0))
        weight = sum((F.when(s.isNotNull(), w).otherwise(0) for s, w in parts), F.lit(0))
        return F.when(weight == 0, 0).otherwise(T.half_even(total / F.nullif(weight, F.lit(0))))

    with_doi = mean([(doi, 60), (title, 20), (author, 15), (year, 5)])
    return F.when(doi.isNull(), mean([(title, 40), (author, 35), (year, 25)])).when(doi == 0, F.least(with_doi, F.lit(49))).otherwise(with_doi).cast("long")


def status(raw: Column, work_type: Column, arxiv: Column, title: Column, author: Column, doi: Column, whole: Column) -> Column:
    low = F.lower(raw)
    return (
        F.when(doi == 100, "verified")
        .when(doi == 0, "metadata_mismatch")
        .when(low.contains("proceedings") & (F.coalesce(work_type, F.lit("")) == "journal-article"), "unresolved")
        .when(low.contains("arxiv") & (F.coalesce(arxiv, F.lit("")) == ""), "partially_verified")
        .when(title < 60, F.when(whole >= PARTIAL, "partially_verified").otherwise("unresolved"))
        .when(author < 80, F.when(author >= PARTIAL, "partially_verified").otherwise("unresolved"))
        .when(whole >= VERIFIED, "verified")
        .when(whole >= PARTIAL, "partially_verified")
        .otherwise("unresolved")
    )


def age(entry_year: Column, year: Column, as_of_year: int) -> Column:
    return F.lit(as_of_year) - F.coalesce(year, entry_year)


def outdated(entry_year: Column, year: Column, as_of_year: int, most: int = MAX_AGE) -> Column:
    return F.coalesce(age(entry_year, year, as_of_year) > most, F.lit(False))


def source_type(work_type: Column) -> Column:
    w = F.lower(F.trim(work_type))
    return F.when(w.isin(PRIMARY), "primary").when(w.isin(SECONDARY), "secondary").otherwise("unknown")


def bibliography_query(doi: Column, title: Column, authors: Column, year: Column) -> Column:
    first = F.split(authors, "(?i)\\s+(?:&|and|ve)\\s+|;", 2)[0]
    first = F.trim(F.split(first, ",", 2)[0])
    parts = [F.nullif(F.coalesce(p, F.lit("")), F.lit("")) for p in (title, first, year.cast("string"))]
    return F.when(F.coalesce(doi, F.lit("")) != "", doi).otherwise(F.trim(F.concat_ws(" ", *parts)))


def conflicts(records: DataFrame) -> DataFrame:
    """(work_id, field, a_api, b_api): providers' records (work_id, pos, api,
    title, year, doi) of one work that disagree; a self-join on the work."""
    a, b = records.alias("a"), records.alias("b")
    pairs = a.join(b, F.expr("a.work_id = b.work_id AND a.pos < b.pos"))
    out = None
    for field, left, right in (
        ("doi", T.normalize_doi(F.col("a.doi")), T.normalize_doi(F.col("b.doi"))),
        ("title", T.normalize_title(F.col("a.title")), T.normalize_title(F.col("b.title"))),
        ("year", F.col("a.year"), F.col("b.year")),
    ):
        rows = pairs.where(left.isNotNull() & right.isNotNull() & (left != right)).select("a.work_id", F.lit(field).alias("field"), F.col("a.api").alias("a_api"), F.col("b.api").alias("b_api"))
        out = rows if out is None else out.unionByName(rows)
    return out


def conflict_notes(records: DataFrame, candidates: DataFrame) -> DataFrame:
    """(entry_id, notes): what providers disagree on. Records (entry_id, work_id,
    pos, api, title, year, doi) of one work and equal DOI that differ in title,
    else in year; only without those, candidates (entry_id, rank, title, year,
    doi, title_score, author_score) that are the first one's work under another
    DOI, by scores against the first. Joins are on the entry."""
    a, b = records.alias("a"), records.alias("b")
    pairs = a.join(b, F.expr("a.entry_id = b.entry_id AND a.work_id = b.work_id AND a.pos < b.pos"))
    pairs = pairs.where(T.normalize_doi(F.col("a.doi")) == T.normalize_doi(F.col("b.doi")))
    x, y = (T.normalize_title(F.coalesce(f"{s}.title", F.lit(""))) for s in "ab")
    who = F.concat(F.col("a.api"), F.lit(" and "), F.col("b.api"))
    note = F.when((x != "") & (y != "") & (x != y), F.concat(F.lit("titles differ: "), who)).when(F.col("a.year") != F.col("b.year"), F.concat(F.lit("years differ: "), who))
    within = pairs.select("a.entry_id", note.alias("note")).where("note IS NOT NULL").distinct()

    first, other = candidates.where("rank = 1").alias("f"), candidates.where("rank > 1").alias("o")
    both = first.join(other, F.col("f.entry_id") == F.col("o.entry_id"))
    fits = (F.col("o.title_score") >= VERIFIED) & F.coalesce(F.col("f.year") == F.col("o.year"), F.lit(True)) & F.coalesce(F.col("o.author_score") >= PARTIAL, F.lit(True))
    across = both.where((T.normalize_doi(F.col("f.doi")) != T.normalize_doi(F.col("o.doi"))) & fits)
    across = across.select("f.entry_id", F.concat(F.lit("one work, two DOIs: "), T.normalize_doi(F.col("f.doi")), F.lit(" and "), T.normalize_doi(F.col("o.doi"))).alias("note")).distinct()
    across = across.join(within.select("entry_id").distinct(), "entry_id", "left_anti")
    return within.unionByName(across).groupBy("entry_id").agg(F.concat_ws("; ", F.array_sort(F.collect_list("note"))).alias("notes"))
