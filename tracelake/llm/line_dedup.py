"""Line deduplication by winnowing over line hashes, in DataFrame functions only.

A window is a run of three lines with a word, or of one or two lines with at least 50 words together.  Each window selects
the line with its least hash (the first of equal ones): a fingerprint, kept once however many windows select it, with the
hashes of the two lines on either side.  Two equal windows select equal lines, so every repeat has a fingerprint in
common.  Fingerprints whose line is selected nowhere else go first.  Those with equal surroundings are then reduced to the
earliest, in the order of document id and line; the later ones repeat all of it.  The earliest of each surroundings are
joined by the windows that selected them to the earliest position of the same window, and each of these matches is
extended line by line both ways, as far as the windows of the fingerprint reach.  The lines of windows inside a match are
deleted: every repeated window but for its first occurrence.  A repeated line, or two, of fewer than 50 words stays.

Lines beside a fingerprint are compared by 64 bits of hash, its own line by 128.

Defined results: null text stays null and has no lines; an empty text has one empty line; windows without a word
never match; rows that repeat an id count as one document and lose the same lines; rows with a null id are left
alone; a document may become empty but no row goes; an empty table gives no rows; all columns of docs are kept.  A very
long text is a longer array of lines, with as many fingerprints as it selects; a very long line is only hashed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracelake.sources.shared import cut

LINES, WORDS = 3, 50
#: Lines on either side of a fingerprint that its windows reach.
REACH = LINES - 1
#: (size, start from the fingerprint) of the windows within its surroundings; the place in this list is the bit in masks.
WINDOWS = [(size, start) for size in range(1, LINES + 1) for start in range(-REACH, REACH - size + 2)]


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def _hash(k: int) -> Column:
    """The hash of the line k after the fingerprint, null outside the text."""
    return F.get("h", F.lit(REACH + k))


def _mask(conditions: list[Column]) -> Column:
    return sum((F.when(c, 1 << bit).otherwise(0) for bit, c in enumerate(conditions)), F.lit(0))


def _bit(mask: str, bit: int) -> Column:
    return F.col(mask).bitwiseAND(1 << bit) != 0


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, at, h array<long>, g, has, may): each selected line, hashes of the lines around it and a second one of its
    own, and masks over WINDOWS: those that count, and those of them that selected it."""
    hashed = F.transform(lines_of(F.col(text)), lambda x: F.struct(
        F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("n")))
    rows = docs.where(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.col(id).alias("doc"), hashed.alias("x"))
    around = F.transform("x", lambda line, i: F.struct(
        i.alias("at"), line["g"].alias("g"), *[F.array(*[F.get("x", i + k)[c] for k in range(-REACH, REACH + 1)]).alias(c) for c in ("h", "n")]))
    lines = rows.select("doc", F.explode(around).alias("line")).select("doc", "line.*")

    def counts(size: int, start: int) -> Column:
        words = sum((F.get("n", F.lit(REACH + start + k)) for k in range(size)), F.lit(0))  # null if it leaves the text
        return F.coalesce(words >= (1 if size == LINES else WORDS), F.lit(False))

    def selects(bit: int, size: int, start: int) -> Column:
        if not start <= 0 < start + size:
            return F.lit(False)
        others = [_hash(k) > _hash(0) if k < 0 else _hash(k) >= _hash(0) for k in range(start, start + size) if k]
        return reduce(Column.__and__, others, _bit("has", bit))

    marked = lines.withColumn("has", _mask([counts(*w) for w in WINDOWS])).where("has <> 0")
    return marked.withColumn("may", _mask([selects(bit, *w) for bit, w in enumerate(WINDOWS)])).where("may <> 0").select("doc", "at", "h", "g", "has", "may")


def repeated_prints(prints: DataFrame) -> DataFrame:
    """The fingerprints whose line is selected at more than one place."""
    own = _hash(0).alias("own")
    twice = prints.groupBy(own).agg(F.min(F.struct("doc", "at")).alias("lo"), F.max(F.struct("doc", "at")).alias("hi")).where("lo <> hi").select("own")
    return prints.join(cut(twice), _hash(0) == F.col("own"), "left_semi")


def _gone(left: Column, right: Column) -> Column:
    """The lines of the windows that count and lie within `left` lines before the fingerprint and `right` after it."""
    def line(k: int) -> Column:
        covers = [_bit("has", bit) & (left >= -start) & (right >= start + size - 1) for bit, (size, start) in enumerate(WINDOWS) if start <= k < start + size]
        return F.when(reduce(Column.__or__, covers), F.col("at") + k)

    return F.explode(F.array_compact(F.array(*[line(k) for k in range(-REACH, REACH + 1)])))


def _extent(way: int) -> Column:
    """How many lines on from the fingerprint, backwards (way -1) or forwards (1), equal those of the earlier place."""
    reached = F.lit(0)
    for k in reversed(range(1, REACH + 1)):
        same = F.coalesce(_hash(way * k) == F.get("lo.h", F.lit(REACH + way * k)), F.lit(False))
        reached = F.when(same, reached + 1).otherwise(0)
    return reached


def repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, gone array<int>): the 0-based lines to delete, in order, for documents that have any."""
    place = F.struct("doc", "at")
    prints = cut(repeated_prints(cut(fingerprints(docs, id, text))))
    inside = F.transform("h", lambda line: line.isNotNull())  # hashing skips nulls
    same = [F.xxhash64("g", "h", inside, F.lit(seed)).alias(name) for seed, name in enumerate("ab")]
    first = cut(prints.groupBy(*same).agg(F.min(F.struct("doc", "at", "h", "g", "has", "may")).alias("lo"), F.max(place).alias("hi")))
    twice = first.where(F.struct("lo.doc", "lo.at") < F.col("hi")).select("a", "b", F.struct("lo.doc", "lo.at").alias("lo"))
    copies = prints.select("doc", "at", "has", *same).join(twice, ["a", "b"]).where(place > F.col("lo"))
    whole = copies.select("doc", _gone(F.lit(REACH), F.lit(REACH)).alias("line"))

    def key(bit: int, size: int, start: int) -> Column:
        parts = [F.lit(bit), F.col("g"), *[_hash(k) for k in range(start, start + size)]]
        return F.when(_bit("may", bit), F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(*parts, F.lit(1)).alias("b")))

    selecting = [key(bit, size, start) for bit, (size, start) in enumerate(WINDOWS) if start <= 0 < start + size]
    keyed = first.select("lo.*").select("doc", "at", "h", "has", F.explode(F.array_compact(F.array(*selecting))).alias("key")).select("doc", "at", "h", "has", "key.*")
    seen = keyed.groupBy("a", "b").agg(F.min(F.struct("doc", "at", "h")).alias("lo"), F.max(place).alias("hi")).where(F.struct("lo.doc", "lo.at") < F.col("hi")).select("a", "b", "lo")
    matches = keyed.join(seen, ["a", "b"]).where(place > F.struct("lo.doc", "lo.at"))
    extended = matches.select("doc", _gone(_extent(-1), _extent(1)).alias("line"))
    gone = whole.unionByName(extended).distinct()
    return gone.groupBy("doc").agg(F.sort_array(F.collect_list("line")).alias("gone"))  # no more than a document has lines


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", keep_gone: bool = False) -> DataFrame:
    """docs with the later occurrences of repeated runs deleted from their texts; keep_gone adds the column `gone`."""
    gone = repeated_lines(docs, id, text).select(F.col("doc").alias("of"), F.col("gone").alias("lost"))
    own = docs.select(F.struct("*").alias("row"), F.col(id).alias("key"), F.col(text).alias("whole"))  # no column of docs clashes with those added
    joined = own.join(gone, F.col("key") == F.col("of"), "left")
    all_lines = lines_of(F.col("whole"))
    left = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("lost"))
    new = F.when(F.col("lost").isNull() | F.col("whole").isNull(), F.col("whole")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(all_lines, i)), "\n"))
    out = joined.select(F.col("row").withField(f"`{text}`", new).alias("row"), F.coalesce("lost", F.array().cast("array<int>")).alias("gone"))
    return out.select("row.*", *(["gone"] if keep_gone else []))


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_deleted, kept_sha256): lines of each text (null: none), lines deleted, SHA-256 of the rest."""
    rows = docs.select("doc_id", "text", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines_of(F.col("text")))).cast("long").alias("n_lines"))
    done = dedup_lines(rows, keep_gone=True)
    return done.select("doc_id", "n_lines", F.size("gone").cast("long").alias("n_deleted"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
