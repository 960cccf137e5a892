"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

A line goes if an equal line, or one within ``distance`` edits of characters, comes earlier: in an earlier document, or
further up in the same one. For distance d, a line is cut into d + 1 disjoint segments of len // (d + 1) characters (the first
at its begin, the last at its end). Two lines within d edits share a segment, moved by few places: with i - 1 edits to the left
of segment i, by at most min(i - 1, d + 1 - i) places or, from the other end, as many. Lines are indexed by (segment number,
length and hash of the segment), probed with the few substrings that can match for their own and for shorter lengths, and
verified with the banded bit-parallel edit distance of Hyyro.

Equal lines are joined first, so that a line that is everywhere is indexed once.

Lines that share a segment are compared inside blocks of bounded size, by a 64-bit sketch: the parities of hashed pairs of
neighbouring characters. An edit changes at most four of them, so a pair whose sketches differ in more than 4 d bits is no match,
and hardly any other pair passes. Of each line only the earliest partner that passes leaves a block, for one that matches is
enough; lines whose earliest partner turns out wrong meet all that pass. A group of n lines with one beginning thus gives n rows
and not n^2. Segments of which a sample shows very many lines are counted apart, so that no task gets all of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import stored

DISTANCE = 2
MIN_CHARS = 20
#: Places of candidate lines (some 70 bytes each) that may be broadcast to fetch their texts; beyond it, a shuffle.
MAX_BROADCAST_ROWS = 500_000
#: Lines of one segment in a block.
BLOCK = 256
#: A segment with so many lines in this share of all lines is counted apart from others; this moves work, and results stay.
HOT_SHARE, HOT_LINES = 1 / 128, 64


def segment_keys(line: Column, distance: int) -> tuple[Column, Column]:
    """(keys under which the line is indexed, further keys that it probes), as arrays of 64-bit hashes."""
    n = F.length(line)

    def key(number: int, size: Column, begin: Column | None) -> Column:
        part = F.right(line, size) if begin is None else F.substring(line, begin + 1, size)
        return F.xxhash64(F.lit(number), size, part)

    def keys(size: Column) -> tuple[list[Column], list[Column]]:
        own, moved = [key(1, size, F.lit(0))], []
        for i in range(2, distance + 1):
            for shift in range(-min(i - 1, distance), min(i - 1, distance) + 1):
                (moved if shift else own).append(key(i, size, size * (i - 1) + shift))
        if distance:
            own.append(key(distance + 1, size, None))
        return own, moved

    size = F.floor(n / (distance + 1)).cast("int")
    own, moved = keys(size)
    lower = F.floor((n - distance) / (distance + 1)).cast("int")  # d shorter: at most one less
    below = [k for part in keys(size - 1) for k in part]
    more = F.array(*moved) if moved else F.array().cast("array<bigint>")
    return F.array(*own), F.when(lower < size, F.concat(more, F.array(*below))).otherwise(more)


def within(longer: Column, shorter: Column, distance: int) -> Column:
    """Whether two arrays of characters, the first at least as long, are within ``distance`` edits (band of 2 d + 1 bits)."""
    width = 2 * distance + 1
    ones = F.lit((1 << width) - 1).cast("long")
    m, n = F.size(longer), F.size(shorter)

    def step(state: Column, i: Column) -> Column:
        char = F.get(shorter, i)
        equal = F.lit(0).cast("long")
        for k in range(width):
            at = i + (k - distance)
            equal = equal + F.when(F.get(longer, at) == char, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
        return F.when(state["d"] > distance * 2, state).otherwise(moved(state, i, equal))

    def moved(state: Column, i: Column, equal: Column) -> Column:
        vp, vn = state["vp"], state["vn"]

        def zeros(e: Column) -> Column:  # diagonals along which the distance stays
            return ((e.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(e).bitwiseOR(vn).bitwiseAND(ones)

        def rest(z: Column) -> Column:
            hp = vn.bitwiseOR(F.bitwise_not(z.bitwiseOR(vp)).bitwiseAND(ones))
            hn = z.bitwiseAND(vp)
            right = F.shiftright(z, 1)
            diagonal = i < m - distance
            mask = F.call_function("shiftleft", F.lit(1).cast("long"), (m - distance + (width - 2) - i).cast("int"))
            along = F.when(hp.bitwiseAND(mask) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(mask) != 0, 1).otherwise(0)
            down = F.when(z.bitwiseAND(F.lit(1 << (width - 1)).cast("long")) != 0, 0).otherwise(1)
            return F.struct(
                hn.bitwiseOR(F.bitwise_not(right.bitwiseOR(hp)).bitwiseAND(ones)).alias("vp"),
                hp.bitwiseAND(right).alias("vn"),
                (state["d"] + F.when(diagonal, down).otherwise(along)).cast("int").alias("d"),
            )

        # a one-element array binds a value that is used more than once
        return F.get(F.transform(F.transform(F.array(equal), zeros), rest), F.lit(0))

    begin = F.struct(F.lit(((1 << width) - 1) & ~((1 << distance) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(distance).alias("d"))
    if not distance:
        return longer == shorter
    return F.aggregate(F.sequence(F.lit(0), n - 1), begin, step)["d"] <= distance


def characters(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0))


def near_lines(longer: Column, shorter: Column, distance: int) -> Column:
    """``within`` for two lines; a one-element array binds their characters, which would else be taken anew at every step."""
    pair = F.array(F.struct(characters(longer).alias("x"), characters(shorter).alias("y")))
    return F.get(F.transform(pair, lambda p: within(p["x"], p["y"], distance)), F.lit(0))


def text_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Lines of at least ``min_chars`` characters: key, t (hash of the text), pos, line."""
    return docs.select("key", "t", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.length("line") >= min_chars)


def sketch(line: Column) -> Column:
    """64 parities of the hashed pairs of neighbouring characters, the first and the last paired with nothing."""
    pairs = F.transform(F.sequence(F.lit(0), F.length(line)), lambda i: F.substring(line, i, F.when(i == 0, 1).otherwise(2)))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda bits, p: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(p).bitwiseAND(F.lit(63).cast("long")).cast("int"))))


def shared_segments(distinct: DataFrame) -> DataFrame:
    """(seg, id, own, n_index, n): keys that at least one line is indexed under and that more than one row has."""

    def keys(lines: DataFrame) -> DataFrame:
        own = F.transform("own", lambda s: F.struct(s.alias("seg"), F.lit(True).alias("own")))
        more = F.transform("more", lambda s: F.struct(s.alias("seg"), F.lit(False).alias("own")))
        return lines.select("id", F.explode(F.concat(own, more)).alias("k")).select("id", "k.*")

    often = keys(distinct.sample(HOT_SHARE, 1)).groupBy("seg").agg(F.count("*").alias("c")).where(F.col("c") >= HOT_LINES)
    often = stored(often.select("seg"), "line-hot-segments")
    indexed = F.col("own").cast("long")
    by_seg = Window.partitionBy("seg")
    cold = keys(distinct).join(often, "seg", "left_anti").select("seg", "id", "own", F.sum(indexed).over(by_seg).alias("n_index"), F.count("*").over(by_seg).alias("n"))
    hot = keys(distinct).join(often, "seg", "left_semi")
    counts = hot.groupBy("seg").agg(F.sum(indexed).alias("n_index"), F.count("*").alias("n"))
    both = cold.unionByName(hot.join(counts, "seg").select("seg", "id", "own", "n_index", "n"))
    return both.where("n > 1 AND n_index > 0")


def earliest_partners(members: DataFrame, distance: int) -> DataFrame:
    """(id, id2, a, a2, since): for each line the earliest line before it that a block of one of its segments finds near by sketch.

    ``members`` has seg, own, n_index, n and item: (first, id, id2, len, sketch).
    """
    def number(rows: str) -> Column:
        return F.pmod(F.xxhash64("item.id"), F.ceil(F.col(rows) / BLOCK)).cast("int")

    index = members.where("own").groupBy("seg", number("n_index").alias("block")).agg(F.collect_list("item").alias("xs"))
    probe = members.groupBy("seg", number("n").alias("part"), F.ceil(F.col("n_index") / BLOCK).cast("int").alias("blocks")).agg(F.collect_list("item").alias("bs"))
    meet = probe.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(index, ["seg", "block"])

    def before(line: Column, others: str, also=None) -> Column:
        def fits(x: Column) -> Column:
            ok = alike(x, line, distance) & (x["first"] < line["first"])
            return ok if also is None else ok & also(x)

        return F.struct(line.alias("line"), F.array_min(F.filter(others, fits)).alias("since"))

    probes = F.transform("bs", lambda b: before(b, "xs"))
    # lines find shorter ones and those of their length, so a longer line also speaks for a shorter one that comes after it
    indexed = F.transform("xs", lambda x: before(x, "bs", lambda b: b["len"] > x["len"]))
    found = meet.select(F.explode(F.filter(F.concat(probes, indexed), lambda p: p["since"].isNotNull())).alias("p"))
    earliest = found.groupBy(F.col("p.line.id").alias("id"), F.col("p.line.id2").alias("id2")).agg(F.min("p.since").alias("since"))
    return earliest.select("id", "id2", F.col("since.id").alias("a"), F.col("since.id2").alias("a2"), F.col("since.first").alias("since"))


def alike(x: Column, y: Column, distance: int) -> Column:
    return (F.abs(x["len"] - y["len"]) <= distance) & (F.bit_count(x["sketch"].bitwiseXOR(y["sketch"])) <= 4 * distance)


def removed_lines(docs: DataFrame, distance: int, min_chars: int) -> DataFrame:
    """(key, t, gone): the positions of the lines that go; docs has key, t and text."""
    here = F.struct("key", "t", "pos")
    line_id = [F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("id2")]
    lines = text_lines(docs, min_chars)
    own, more = segment_keys(F.col("line"), distance)
    distinct = stored(
        lines.select(*line_id, here.alias("at"), own.alias("own"), more.alias("more"))
        .groupBy("id", "id2")
        .agg(F.min("at").alias("first"), F.count("*").alias("n"), F.first("own").alias("own"), F.first("more").alias("more")),
        "lines",
    )
    shared = stored(shared_segments(distinct), "line-segments")

    wanted = shared.select("id").distinct()
    firsts = stored(distinct.select("id", "id2", "first").join(wanted, "id"), "line-firsts")
    places = firsts.select("id", "id2", "first", F.col("first.key").alias("k"), F.col("first.t").alias("t2"), F.col("first.pos").alias("pos2"))
    if places.count() <= MAX_BROADCAST_ROWS:
        places = F.broadcast(places)
    here_too = F.col("key").eqNullSafe(F.col("k")) & (F.col("t") == F.col("t2")) & (F.col("pos") == F.col("pos2"))
    texts = lines.join(places, here_too).select("id", "id2", "first", "line").dropDuplicates(["id", "id2"])
    texts = stored(texts.select("id", "id2", "first", "line", F.length("line").alias("len"), sketch(F.col("line")).alias("sketch")), "line-texts")
    items = texts.select(F.col("id").alias("of"), F.struct("first", "id", "id2", "len", "sketch").alias("item"))
    members = stored(shared.join(items, F.col("id") == F.col("of")).select("seg", "own", "n_index", "n", "item"), "line-members")

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of (id, id2, a, a2, since) that are within the distance."""
        left = texts.select("id", "id2", F.col("line").alias("x"))
        right = texts.select(F.col("id").alias("a"), F.col("id2").alias("a2"), F.col("line").alias("y"))
        both = pairs.join(left, ["id", "id2"]).join(right, ["a", "a2"])
        longer, shorter = (F.when(c, F.col("x")).otherwise(F.col("y")) for c in (F.length("x") >= F.length("y"), F.length("x") < F.length("y")))
        return both.where(near_lines(longer, shorter, distance)).select("id", "id2", "since")

    first_found = stored(earliest_partners(members, distance), "line-partners")
    sure = stored(verified(first_found), "line-near")
    open_lines = first_found.join(sure.select("id", "id2"), ["id", "id2"], "left_anti").select(F.col("id").alias("u"), F.col("id2").alias("u2"))
    asked = members.join(open_lines, (F.col("item.id") == F.col("u")) & (F.col("item.id2") == F.col("u2"))).select("seg", F.col("own").alias("own_u"), F.col("item").alias("line"))
    meets = (F.col("own") | F.col("own_u")) & alike(F.col("item"), F.col("line"), distance) & (F.col("item.first") < F.col("line.first"))
    others = members.join(asked, "seg").where(meets).select(F.col("line.id").alias("id"), F.col("line.id2").alias("id2"), F.col("item.id").alias("a"), F.col("item.id2").alias("a2"), F.col("item.first").alias("since")).distinct()
    since = sure.unionByName(verified(others)).groupBy("id", "id2").agg(F.min("since").alias("since"))
    again = distinct.select("id", "id2", "first", "n").join(since, ["id", "id2"], "left").where("n > 1 OR since IS NOT NULL").select("id", "id2", F.coalesce("since", "first").alias("since"))
    gone = lines.select(*line_id, "key", "t", "pos").join(again, ["id", "id2"]).where(here > F.col("since"))
    return gone.groupBy("key", "t").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of ``docs`` with ``text`` less the repeated lines, then ``n_lines`` and ``n_removed``.

    Lines are split at \\n. A line of ``min_chars`` characters or more goes if one that is equal or within ``distance`` edits
    comes before it in the order of (key, hash of the text, position); a null key comes first. It goes whether or not the
    earlier one goes itself. Shorter lines stay. Rows with the same key and text are one document and get the same answer.
    A null text stays null, with no lines; an empty text has one empty line. An empty table gives no rows.
    """
    if min_chars < 3 * distance + 3:
        raise ValueError("segments need three characters: min_chars must be 3 * distance + 3 or more")
    slim = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    gone = removed_lines(slim, distance, min_chars).select(F.col("key").alias("__key"), F.col("t").alias("__t"), F.col("gone").alias("__gone"))
    joined = docs.join(gone, F.col(key).eqNullSafe(F.col("__key")) & (F.xxhash64(text) == F.col("__t")), "left")
    parts = F.split(text, "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "__gone"), lambda i: F.get(parts, i))
    new = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.concat_ws("\n", kept))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).cast("long")
    others = [new.alias(c) if c == text else F.col(c) for c in docs.columns]
    return joined.select(*others, n_lines.alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"))
