"""Expected evidence against the evidence of a bundle: who may match, and how well.

Patterns meet paths by what both have in front of the first wild card; expectations
meet units in rows of those alike, of which only the first that fit go further.
Line ranges alone meet by cells of growing size (``overlapping_lines``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a match is worth, and what an exact path, a wild card that
# holds, a member and a line range add.
BASE, EXACT, GLOB, MEMBER, LINES = 10, 100, 50, 20, 10
#: Cells of 8, 64, 512, ... lines; the last holds every int.
LEVELS = 11
#: Units in a row of units that are alike.
CHUNK = 1024


def _literal(c: Column) -> Column:
    return F.when(c.rlike(r"\A[A-Za-z0-9]\z") | (F.ascii(c) > 127), c).otherwise(F.concat(F.lit("\\"), c))


def _class(token: Column) -> Column:
    """A bracketed set of signs as a pattern; null if it isn't well formed."""
    body = F.regexp_replace(token, r"\A\[\^?|\]\z", "")
    parts = F.regexp_extract_all(body, F.lit(r"(?s)(.-.|.)"), F.lit(1))
    said = F.transform(parts, lambda p: F.when(F.char_length(p) == 1, _literal(p)).when(p.substr(1, 1) <= p.substr(3, 1), F.concat(_literal(p.substr(1, 1)), F.lit("-"), _literal(p.substr(3, 1)))).otherwise(""))
    joined = F.array_join(said, "")
    out = F.when(token.startswith("[^"), F.concat(F.lit("[^/"), joined, F.lit("]"))).when(joined == "", F.lit("(?!)")).otherwise(F.concat(F.lit("["), joined, F.lit("]")))
    return F.when(~body.rlike(r"\A-|-\z|--"), out)


def glob_pattern(glob: Column) -> Column:
    """A path glob as a pattern for the whole path; null if it isn't well formed.

    ``*`` and ``?`` stop at slashes, brackets hold signs and ranges, ``^`` turns them
    round; a set never matches a slash.
    """
    tokens = F.regexp_extract_all(glob, F.lit(r"(?s)(\[\^?[^\]]+\]|.)"), F.lit(1))
    one = F.transform(tokens, lambda t: F.when(t == "*", F.lit("[^/]*")).when(t == "?", F.lit("[^/]")).when(t == "[", F.lit(None).cast("string")).when(F.char_length(t) > 1, _class(t)).otherwise(_literal(t)))
    return F.when(~F.exists(one, lambda t: t.isNull()), F.concat(F.lit(r"\A(?s:"), F.array_join(one, ""), F.lit(r")\z")))


def _slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def matching_paths(patterns: DataFrame, paths: DataFrame) -> DataFrame:
    """bundle_id, pattern, path, exact: the paths of a bundle that a pattern means.

    ``patterns``: bundle_id, pattern; ``paths``: bundle_id, path; nulls match nothing.
    A pattern meets only paths with its number of parts that begin with its parts
    before the first with a wild card; a path is listed once for each beginning.
    """
    p = patterns.filter("pattern is not null").distinct().withColumn("glob", _slashes(F.col("pattern")))
    parts = F.split("glob", "/", -1)
    wild = F.transform(parts, lambda s: s.rlike(r"[*?\[]"))
    k = F.when(F.array_contains(wild, True), F.array_position(wild, True) - 1).otherwise(F.size(parts))
    p = p.withColumns({"n": F.size(parts), "head": F.xxhash64(F.array_join(F.slice(parts, F.lit(1), k.cast("int")), "/"), k.cast("int"))})
    p = p.withColumn("regex", F.when(F.array_contains(wild, True), glob_pattern(F.col("glob"))))
    whole = F.split(_slashes(F.col("path")), "/", -1)
    heads = F.transform(F.sequence(F.lit(0), F.size(whole)), lambda i: F.xxhash64(F.array_join(F.slice(whole, F.lit(1), i), "/"), i))
    a = paths.filter("path is not null").select("bundle_id", "path").distinct().select("bundle_id", "path", F.size(whole).alias("n"), F.explode(heads).alias("head"))
    own = _slashes(F.col("path"))
    hit = (F.col("glob") == own) | F.coalesce(F.rlike(own, F.col("regex")), F.lit(False))
    return p.join(a, ["bundle_id", "n", "head"]).filter(hit).select("bundle_id", "pattern", "path", (F.col("pattern") == F.col("path")).alias("exact"))


def _cells(rows: DataFrame) -> DataFrame:
    """``rows`` with start and end, once for each cell they lie in, from the smallest
    cells that are no shorter than they are to the largest: at most two of a size."""
    size = [8 ** (j + 1) for j in range(LEVELS)]
    own = F.lit(LEVELS - 1)
    for j in reversed(range(LEVELS - 1)):
        own = F.when(F.col("end") - F.col("start") < size[j], j).otherwise(own)
    each = [F.when(F.lit(j) >= F.col("own"), F.transform(F.array_distinct(F.array(F.floor(F.col("start") / size[j]), F.floor(F.col("end") / size[j]))), lambda c: F.struct(F.lit(j).alias("level"), c.alias("cell")))) for j in range(LEVELS)]
    return rows.withColumn("own", own).withColumn("at", F.explode(F.flatten(F.array_compact(F.array(*each))))).select(*rows.columns, "own", F.col("at.level").alias("level"), F.col("at.cell").alias("cell"))


def overlapping_lines(wanted: DataFrame, units: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of ``wanted`` and ``units`` equal in ``key`` whose line ranges overlap.

    Both have start and end (long, start <= end), and no other common names. Two
    ranges meet in cells of the size of the longer one, and count in the later of
    their first cells there; so a hot path is split, and no pair comes twice.
    """
    x = _cells(wanted).withColumnsRenamed({"start": "x_start", "end": "x_end", "own": "x_own"})
    u = _cells(units).withColumnsRenamed({"start": "u_start", "end": "u_end", "own": "u_own"})
    both = x.join(u, [*key, "level", "cell"]).filter((F.col("level") == F.greatest("x_own", "u_own")) & (F.col("x_start") <= F.col("u_end")) & (F.col("u_start") <= F.col("x_end")))
    size = F.element_at(F.array(*[F.lit(8 ** (j + 1)) for j in range(LEVELS)]), F.col("level") + 1)
    return both.filter(F.col("cell") == F.floor(F.greatest("x_start", "u_start") / size)).drop("level", "cell", "x_own", "u_own", "x_start", "x_end", "u_start", "u_end")


def _given(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def _classes(units: DataFrame, keys: list[str]) -> DataFrame:
    """``units`` alike in ``keys``: rows of at most CHUNK of them as items (id, start,
    end), ascending by id; chunk counts the rows of a class from 0."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("evidence_id"))
    rows = units.select(*keys, F.struct(F.col("evidence_id").alias("id"), "start", "end").alias("item"), F.floor((place - 1) / CHUNK).cast("int").alias("chunk"))
    return rows.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list("item")).alias("items"))


def scored_matches(expected: DataFrame, units: DataFrame) -> DataFrame:
    """case_id, expected_id, evidence_id, score, place: who may match, best first.

    ``expected``: bundle_id, case_id, expected_id, path (a glob, null or empty: any),
    member, attribute, start_line, end_line; ``units``: bundle_id, evidence_id, path,
    member, method, content, start_line, end_line. A member must be part of a unit's
    member, method or content, an attribute of its content (A-Z as a-z). Lines count
    if one is above 0; a missing start is 1, an end before it the start; a unit
    without lines matches all. Ids must tell rows apart.

    An expectation lists only as many units as its case has expectations at most:
    a matching takes no more, so the rest can't change it. An expectation meets
    rows of units that are alike to it, and keeps of each row the first ids only,
    so single pairs are never shuffled.
    """
    has_path, asks = F.nullif("path", F.lit("")).isNotNull(), _given(F.col("member")).isNotNull() | F.nullif("attribute", F.lit("")).isNotNull()
    kinds = expected.groupBy("case_id").agg(F.count("*").alias("n"), F.collect_set(F.struct(has_path.alias("pathed"), asks.alias("asked"))).alias("kinds"))
    told = kinds.agg(F.max("n").alias("most"), F.array_distinct(F.flatten(F.collect_set("kinds"))).alias("kinds")).first()  # four kinds at most
    most, wanted_kinds = told["most"] or 1, {(k["pathed"], k["asked"]) for k in told["kinds"]} or {(False, False)}
    start, end = F.coalesce("start_line", F.lit(0)).cast("long"), F.coalesce("end_line", F.lit(0)).cast("long")
    first = F.greatest(start, F.lit(1))
    x = expected.select(
        "bundle_id", "case_id", "expected_id", F.nullif("path", F.lit("")).alias("pattern"), _given(F.col("member")).alias("wanted"), F.nullif(F.lower("attribute"), F.lit("")).alias("attribute"),
        ((start > 0) | (end > 0)).alias("lined"), first.alias("from"), F.greatest(end, first).alias("till"),
    )
    x = x.withColumn("worth", F.lit(BASE) + F.when(F.col("wanted").isNotNull(), MEMBER).otherwise(0) + F.when(F.col("lined"), LINES).otherwise(0))
    u = units.select(
        "bundle_id", "evidence_id", "path", F.when(start > 0, start).alias("start"), F.when(start > 0, F.greatest(end, start)).alias("end"),
        F.lower("content").alias("content"), F.array(*[F.lower(F.coalesce(c, F.lit(""))) for c in ("member", "method")]).alias("names"),
    )
    said = F.col("wanted").isNull() | F.exists("names", lambda n: n.contains(F.col("wanted"))) | F.coalesce(F.col("content").contains(F.col("wanted")), F.lit(False))
    said = said & (F.col("attribute").isNull() | F.coalesce(F.col("content").contains(F.col("attribute")), F.lit(False)))
    hit = lambda i: i["start"].isNull() | ((F.col("from") <= i["end"]) & (i["start"] <= F.col("till")))
    listed = F.when(F.col("lined"), F.filter("items", hit)).otherwise(F.col("items"))
    found = None
    for pathed, asked in sorted(wanted_kinds):
        own = x.filter(F.col("pattern").isNotNull() == pathed).filter((F.col("wanted").isNotNull() | F.col("attribute").isNotNull()) == asked)
        on = ["bundle_id", "path"] if pathed else ["bundle_id"]
        if pathed:
            meant = matching_paths(own.select("bundle_id", "pattern"), u.select("bundle_id", "path"))
            own = own.join(meant, ["bundle_id", "pattern"]).withColumn("worth", F.col("worth") + F.when(F.col("exact"), EXACT).otherwise(GLOB)).drop("exact")
        both = own.drop("pattern").join(_classes(u, on + ["names", "content"] * asked), on)
        both = both.filter(F.col("lined") | (F.col("chunk") * CHUNK < most))
        both = both.filter(said) if asked else both
        ids = F.transform(F.slice(listed, 1, most), lambda i: i["id"])
        rows = both.select("case_id", "expected_id", F.struct((-F.col("worth")).alias("worth"), ids.alias("ids")).alias("some")).filter(F.size("some.ids") > 0)
        found = rows if found is None else found.unionByName(rows)
    each = F.flatten(F.transform("every", lambda s: F.transform(s["ids"], lambda i: F.struct(s["worth"].alias("worth"), i.alias("id")))))
    best = found.groupBy("case_id", "expected_id").agg(F.collect_list("some").alias("every")).select("case_id", "expected_id", F.posexplode(F.slice(F.sort_array(each), 1, most)).alias("place", "one"))
    return best.select("case_id", "expected_id", F.col("one.id").alias("evidence_id"), (-F.col("one.worth")).alias("score"), (F.col("place") + 1).alias("place"))
