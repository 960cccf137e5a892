from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.llm import graph, jaccard, lines
from cohortry.llm.common import WORD


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, text, times, alphabet="abcé😀"):
    out = list(text)
    for _ in range(times):
        at = rng.randrange(len(out) + 1)
        what = rng.random()
        if what < 0.34 or at == len(out):
            out.insert(at, rng.choice(alphabet))
        elif what < 0.67:
            del out[at]
        else:
            out[at] = rng.choice(alphabet)
    return "".join(out)


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_banded_distance_and_segments_against_the_full_table(spark, distance):
    rng, rows = random.Random(distance), []
    for _ in range(400):
        a = "".join(rng.choice("abcé😀") for _ in range(rng.randint(12, 40)))
        b = changed(rng, a, rng.randint(0, 5))
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        if len(a) - len(b) <= distance and len(b) >= 3 * distance + 3:
            rows.append((a, b, edits(a, b) <= distance))
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    own_a, more_a = lines.segment_keys(F.col("a"), distance)
    own_b, _ = lines.segment_keys(F.col("b"), distance)
    shared = F.arrays_overlap(F.concat(own_a, more_a), own_b)
    got = df.select("want", lines.within(lines.characters(F.col("a")), lines.characters(F.col("b")), distance).alias("near"), shared.alias("shared")).collect()
    assert all(r.near == r.want for r in got) and any(r.want for r in got) and not all(r.want for r in got)
    assert all(r.shared for r in got if r.want)


def brute_lines(rows, distance, min_chars):
    """rows: (doc_id, text) with distinct ids; what each text becomes."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0]))
    before, out = [], {}
    for i in order:
        text, kept = rows[i][1], []
        if text is None:
            out[rows[i][0]] = (None, 0)
            continue
        for line in text.split("\n"):
            if len(line) >= min_chars and any(abs(len(line) - len(x)) <= distance and edits(line, x) <= distance for x in before):
                before.append(line)
                continue
            if len(line) >= min_chars:
                before.append(line)
            kept.append(line)
        out[rows[i][0]] = ("\n".join(kept), text.count("\n") + 1 - len(kept))
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_line_dedup_against_brute_force(spark, documents, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(lines, "MAX_BROADCAST_ROWS", -1)
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(9, 60))) for _ in range(25)]
    rows = [(None, "\n".join(base[:2])), (0, None), (1, ""), (2, "short\nshort"), (3, "\n\n")]
    for i in range(4, 60):
        rows.append((i, "\n".join(changed(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 6])) for _ in range(rng.randint(1, 6)))))
    rows.append((60, "\n".join(changed(rng, rng.choice(base), 1) for _ in range(400))))  # a long one
    rows.append((61, rows[60][1]))
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(documents(rows, extra=True).repartition(5), min_chars=12).collect()}
    assert got == brute_lines(rows, 2, 12)


def test_line_dedup_edges(spark, documents):
    assert lines.dedup_lines(documents([])).collect() == []
    same = "a line of more than twenty characters"
    out = lines.dedup_lines(documents([(7, same), (7, same), (9, same), (7, same + "\nanother line that is long enough")]))
    got = sorted((r.doc_id, r.text, r.n_removed) for r in out.collect())
    kept = [t for _, t, _ in got if t.startswith(same)]
    # rows that repeat key and text are one document; under one key, texts come in the order of their hashes
    assert len(got) == 4 and got[-1] == (9, "", 1) and len(kept) in (1, 2)
    with pytest.raises(ValueError):
        lines.dedup_lines(documents([]), distance=2, min_chars=8)


def test_many_lines_with_one_beginning(spark, documents):
    """A crowded segment: only the planted copies go, also where every line is near every other."""
    rng = random.Random(9)
    begin = "all of these lines begin with the same forty characters: "
    lines_ = [begin + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(3000)]
    planted = [changed(rng, x, rng.choice([1, 2]), "ABC") for x in lines_[::50]]
    rows = [(i, x) for i, x in enumerate(lines_ + planted)]
    rows += [(10_000 + i, f"and these are within two edits of one another, {i:02d}") for i in range(100)]
    out = {r.doc_id: r.n_removed for r in lines.dedup_lines(documents(rows).repartition(6)).collect()}
    assert {i for i, n in out.items() if n} == {*range(3000, 3000 + len(planted)), *range(10_001, 10_100)}


def test_sketch_bounds_edits(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(400):
        a = "".join(rng.choice("abcé😀 ") for _ in range(rng.randint(9, 60)))
        n = rng.randint(0, 3)
        rows.append((a, changed(rng, a, n), n))
    df = spark.createDataFrame(rows, "line string, other string, n int")
    differ = F.bit_count(lines.sketch(F.col("line")).bitwiseXOR(lines.sketch(F.col("other"))))
    assert df.where(differ > 4 * F.col("n")).count() == 0


def shingles(text, width=5):
    words = WORD.findall(text or "")
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_classes(rows, similarity=0.8):
    sets = [shingles(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity] for i in range(len(rows))]
    root = list(range(len(rows)))
    changed_ = True
    while changed_:
        changed_ = False
        for i, others in enumerate(near):
            low = min([root[i], *(root[j] for j in others)])
            if low != root[i]:
                root[i] = low
                changed_ = True
    out = []
    for i in range(len(rows)):
        keys = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((rows[i][0], min(keys) if keys else None, len(near[i])))
    return sorted(out, key=str)


def corpus(rng):
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = [(None, "one two three four five six seven"), (0, None), (1, ""), (2, " \n\t"), (3, "just three words"), (4, "just  three words"), (5, "a b c d e f g h i"), (6, "a b c d e f g h j")]
    for i in range(10, 60):  # a passage that many share, between words of their own
        own = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        at = rng.randrange(len(own))
        rows.append((i, " ".join(own[:at] + passage + own[at:])))
    base = [rng.choice(words) for _ in range(300)]
    for i in range(60, 130):  # a large group of near copies
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    rows += [(200 + i, " ".join(base)) for i in range(30)] + [(200, " ".join(base)), (9, rows[30][1])]
    rows.append((300, " ".join(rng.choice(words) for _ in range(20_000))))
    return rows


@pytest.mark.parametrize("small,block,set_block,broadcast", [(4096, 4096, 512, True), (8, 16, 16, False)])
def test_classes_against_brute_force(spark, documents, monkeypatch, small, block, set_block, broadcast):
    monkeypatch.setattr(jaccard, "SKETCH_BLOCK", block)
    monkeypatch.setattr(jaccard, "SET_BLOCK", set_block)
    if not broadcast:
        monkeypatch.setattr(jaccard, "MAX_BROADCAST_KEYS", -1)
    rows = corpus(random.Random(3))
    got = jaccard.classes(documents(rows, extra=True).repartition(6), small=small).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute_classes(rows)


def test_no_pair_of_short_texts_is_lost_at_the_threshold(spark, documents):
    rng, rows = random.Random(8), []
    for pair in range(3000):  # runs of words that come once: n shingles, and n + n // 4 of which n are the same
        n = (4, 8, 20)[pair % 3]
        words = [f"{pair}x{rng.getrandbits(40)}" for _ in range(n + n // 4 + 4)]
        rows += [(2 * pair, " ".join(words[: n + 4])), (2 * pair + 1, " ".join(words))]
    got = jaccard.classes(documents(rows).repartition(8)).collect()
    assert all(r.n_links == 1 and r.class_id == r.doc_id // 2 * 2 for r in got) and len(got) == len(rows)


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.9])
def test_sketches_reject_only_below_the_similarity(similarity):
    rng = np.random.default_rng(9)
    rejected = 0
    for _ in range(300):
        n = int(rng.choice([1, 4, 9, 100, 250, 300, 1000, 5000]))
        tokens = rng.integers(0, 2**64, 2 * n + 2, np.uint64)
        a, b = tokens[:n], tokens[int(rng.integers(0, n)) : n + int(rng.integers(0, n // 3 + 2))]
        common = len(np.intersect1d(a, b))
        near = common / (len(a) + len(b) - common) >= similarity
        found = jaccard.near_sketches(np.array([len(a), len(b)]), [jaccard.sketch(a), jaccard.sketch(b)], similarity)
        assert found or not near
        rejected += not found
    assert rejected > 30


def test_keep_one_and_edges(spark, documents):
    rows = corpus(random.Random(4))
    df = documents(rows, extra=True)
    out = jaccard.keep_one(df)
    assert out.columns == df.columns
    kept = [r.doc_id for r in out.collect()]
    want = {c for _, c, _ in brute_classes(rows)}
    assert set(kept) == want and kept.count(60) <= 1 and kept.count(200) == 0
    assert jaccard.classes(documents([])).collect() == [] and jaccard.keep_one(documents([])).collect() == []
    twice = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (2, None)]
    assert sorted(r.doc_id for r in jaccard.keep_one(documents(twice)).collect()) == [1, 2, 2]


def test_runs_follow_from_the_recall():
    assert jaccard.runs_for(0.99, 1) == 5 and jaccard.runs_for(0.995, 3) > jaccard.runs_for(0.99, 3) > jaccard.runs_for(0.99, 1)


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(201, 202), (202, 203), (203, 201), (5, 5)]
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(7, 60)}, 201: 201, 202: 201, 203: 201}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []
