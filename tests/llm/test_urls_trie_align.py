from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import xxhash
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortry.llm import align, trie, urls
from cohortry.llm.queries import URL_RULES

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")

# ---------------------------------------------------------------------------
# URL filters
# ---------------------------------------------------------------------------


def judged(spark, addresses, rules=URL_RULES, words=urls.HOST_WORDS):
    pages = spark.createDataFrame([(i, a, "x", "y") for i, a in enumerate(addresses)], "page_id long, url string, rule string, host string")
    return {r["page_id"]: r for r in urls.judge(pages, urls.build(urls.entries(spark, rules, words))).collect()}


def plain(url, rules, words):
    if url is None or "://" not in url:
        host = tail = ""
    else:
        host, tail = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and tail.startswith(p)]
    if fits:
        *_, verdict, rule = max(fits)
        return host, tail, rule, verdict
    return host, tail, None, "block" if any(w in words for w in re.findall("[a-z0-9]+", host)) else "allow"


def test_digests_are_those_of_the_engine(spark):
    texts = ["", "a", "rule:example.org/es/", "ü" * 40, "x" * 33]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()
    assert all(np.uint64(xxhash.xxh64_intdigest(r["t"].encode(), urls.SEED)).astype(np.int64) == r["h"] for r in rows)


def test_addresses_against_every_rule(spark):
    rng = random.Random(5)
    hosts = ["org", "example.org", "a.example.org", "notexample.org", "EXAMPLE.com", "x.com", "com", "casino-win.example.net", "my-casino.example.org", "", "net", "ÄB.org", "a..org", ".org", "org.", "user@x.com:80"]
    tails = ["", "/", "/es/", "/es", "/en/1", "/en/123?x=/es/", "/fr/#a", "/de/x", "?q", "#f", "//", "/Es/", "/es/\n/x"]
    addresses = [None, "", "no scheme", "://", "a://b://c/de/", *(f"http://{rng.choice(hosts)}{rng.choice(tails)}" for _ in range(400)), "http://x.com/de/" + "y" * 100_000]
    found = judged(spark, addresses)
    assert len(found) == len(addresses)
    for i, a in enumerate(addresses):
        assert (found[i]["host"], found[i]["path"], found[i]["rule"], found[i]["verdict"]) == plain(a, URL_RULES, urls.HOST_WORDS)


def test_many_rules_in_many_files_and_verdicts_that_differ(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rules = [(f"h{i % 50}.net", f"/{i}/"[: i % 4], "block" if i % 3 else "allow") for i in range(400)]
        found = urls.build(urls.entries(spark, rules))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found.files) > 1
    pages = spark.createDataFrame([(i, f"http://s.h{i % 60}.net/{i}/") for i in range(800)], "page_id long, url string")
    once = {}  # one string, two verdicts: it blocks
    for h, p, v in rules:
        once[h, p] = "block" if "block" in (v, once.get((h, p))) else "allow"
    merged = [(h, p, v) for (h, p), v in once.items()]
    for r in urls.judge(pages, found).collect():
        assert (r["rule"], r["verdict"]) == plain(f"http://s.h{r['page_id'] % 60}.net/{r['page_id']}/", merged, urls.HOST_WORDS)[2:]


def test_two_strings_with_one_digest_are_told_apart(tmp_path):
    key = b"rule:a.net/"
    digest = np.uint64(xxhash.xxh64_intdigest(key, urls.SEED)).astype(np.int64)
    name = tmp_path / "f"
    for texts, block, want in ((["other", "third"], [True, True], -1), (["other", "rule:a.net/"], [True, False], 0)):
        name.write_bytes(b"".join(urls.file_parts(np.array([digest, digest]), texts, block)))
        assert urls.DigestArray(urls.Filter([(int(digest), str(name))], str(tmp_path))).find([key, b"none"]).tolist() == [want, -1]


def test_empty_lists_tables_and_null_keys(spark):
    assert {r["verdict"] for r in judged(spark, ["http://casino.org/"], (), ()).values()} == {"allow"}
    assert judged(spark, []) == {}
    pages = spark.createDataFrame([(None, None), (1, "http://x.org/"), (1, "http://x.org/")], "page_id long, url string")
    assert [tuple(r)[::4] for r in urls.judge(pages, urls.build(urls.entries(spark, URL_RULES))).orderBy("page_id").collect()] == [(None, "allow"), (1, "allow"), (1, "allow")]


# ---------------------------------------------------------------------------
# conversation trie
# ---------------------------------------------------------------------------


def every_node(rows, group=20, heads=4):
    """The contract, node by node."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(r, x) for *_, r, _, x in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        whole[c] = own.get(c - int(math.fmod(c, group)), [])[:h] + v[h:]
    members, below, found = defaultdict(list), defaultdict(list), []
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        totals[node] = sum(totals[k][0] for k in below[node]) or 1, saved + sum(totals[k][1] for k in below[node])
        if node:
            below[node[:-1]].append(node)
        ends = ",".join(map(str, sorted(c for c in members[node] if len(whole[c]) == len(node))))
        found.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below[node]), *totals[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=str)


@pytest.mark.parametrize("seed, block_rows, forests", [(0, 1, 2), (1, 3, 2), (2, 2, 3), (3, 7, 128), (4, 1000, 128), (5, 1, 128)])
def test_trie_equals_every_node(spark, seed, block_rows, forests):
    rng = random.Random(seed)
    rows = [(c, rng.choice([t, t, None]), rng.choice(["u", "u", None]), rng.choice(["a b", "c", None, "d  e\nf"])) for c in range(rng.choice([40, 90])) for t in range(rng.choice([0, 1, 2, 3, 6]))]
    rows += [(c, t, "u", "same words") for c in range(200, 260) for t in range(5)]  # a third are copies
    rows += [(None, 1, "u", "x"), (-3, 1, "u", "x"), (-20, 1, "u", "y")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, path string")
    for conf in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", conf)
        found = [tuple(r) for r in trie.trie(trie.rebuilt(df), block_rows, forests, ids=2).collect()]
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert sorted(found, key=str) == every_node([r for r in rows])


def test_trie_of_long_and_turnless_conversations_and_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, t, "u", f"w {t}") for t in range(3000)] + [(2, t, "u", f"w {t}") for t in range(2500)] + [(21, 0, "u", "z")]
    found = sorted((tuple(r) for r in trie.nodes(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert found == every_node(rows)
    assert any(zlib.crc32(str(c).encode()) % 4 for c in (1, 2, 21))  # so that some lose turns of their own
    assert trie.nodes(spark.createDataFrame([], schema)).count() == 0


def test_common_turns():
    rng = random.Random(1)
    for _ in range(300):
        a, b = (b"".join(bytes([rng.randint(0, 1)]) * 16 for _ in range(rng.randint(0, 9))) for _ in range(2))
        want = next((i for i in range(min(len(a), len(b)) // 16) if a[16 * i : 16 * i + 16] != b[16 * i : 16 * i + 16]), min(len(a), len(b)) // 16)
        assert trie.common_turns(a, b) == want


# ---------------------------------------------------------------------------
# alignment
# ---------------------------------------------------------------------------

ODD = ["", " ", "  ", " a", "a ", "a  ", "  a  b ", "a\n b", "a \n b", "\x1c b", "a\x1c b", "Don't STOP's", "a\xa0b \xa0 c", "<|endoftext|> x", "<s> </s> <0x41> <unk>", "▁ marker", "日本語 text 😀😀 ½", "\x00\x01 x", "é E\u0301\u0301 ñ", "a" * 300, "x\u180e b", "\x85 b\t c"]


def plainly(text, a, b, bytes_a, bytes_b):
    """Counts, links and groups of one text by definition; None without tokens."""
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if not b"".join(bytes_a[i] for i in ids_a) == b"".join(bytes_b[i] for i in ids_b) == (" " + text).encode():
        return None

    def spans(sizes):
        ends = np.cumsum(sizes).tolist()
        return list(zip([0, *ends], ends))

    at_a, at_b = spans([len(bytes_a[i]) for i in ids_a]), spans([len(bytes_b[i]) for i in ids_b])
    common, groups, i, j = sorted({e for _, e in at_a} & {e for _, e in at_b}), [], 0, 0
    for e in common:
        x, y = i, j
        while i < len(ids_a) and at_a[i][1] <= e:
            i += 1
        while j < len(ids_b) and at_b[j][1] <= e:
            j += 1
        groups.append(f"{','.join(map(str, ids_a[x:i]))}|{','.join(map(str, ids_b[y:j]))}")
    links = [(ids_a[x], ids_b[y]) for x in range(len(ids_a)) for y in range(len(ids_b)) if at_a[x][0] < at_b[y][1] and at_b[y][0] < at_a[x][1]]
    return len(ids_a), len(ids_b), links, groups


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    own = align.Aligner(A, B)
    return a, sentencepiece.SentencePieceProcessor(model_file=B), own.bytes_a, own.bytes_b


def odd_texts(n):
    rng = random.Random(n)
    return ODD + ["".join(rng.choice("aBé'.,1½ \n \t \xa0ß\u0301😀▁<s>日\x85\u2028\u3000") for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_aligner_equals_the_definition(sides):
    own = align.Aligner(A, B)
    for text in odd_texts(800):
        counts, hashes, links, n = own([text])
        want = plainly(text, *sides)
        if want is None:
            assert counts.tolist() == [[0, 0, 0, 0]] and hashes == [""] and not len(links)
        else:
            n_a, n_b, pairs, groups = want
            assert counts.tolist() == [[n_a, n_b, len(groups), len(pairs)]] and n.tolist() == [len(pairs)]
            assert hashes == [hashlib.sha256(";".join(groups).encode()).hexdigest()]
            assert Counter((x // own.wide_b, x % own.wide_b) for x in links.tolist()) == Counter(pairs)


def test_diagonal_runs_against_a_plain_walk():
    rng = np.random.default_rng(2)
    for _ in range(300):
        end = int(rng.integers(1, 200))
        a, b = (np.unique(np.append(rng.integers(1, end + 1, rng.integers(0, end)), end)) for _ in range(2))
        if rng.random() < 0.5:
            b = np.unique(np.append(a, rng.integers(1, end + 1, 2)))
        found = []
        for i, j, n, m in align.one_to_one(a.tolist(), b.tolist()):
            found += [((i + x, i + x + 1), (j + x, j + x + 1)) for x in range(n)] if m < 0 else [((i, i + n), (j, j + m))]
        common = np.intersect1d(a, b)
        x, y = np.searchsorted(a, common) + 1, np.searchsorted(b, common) + 1
        assert found == list(zip(zip([0, *x[:-1].tolist()], x.tolist()), zip([0, *y[:-1].tolist()], y.tolist())))


@pytest.mark.parametrize("chunk", [1, 200, 1 << 20])
def test_counts_over_the_corpus(spark, documents, sides, chunk):
    texts = [*odd_texts(60), "the same words", "the same words", "the same, words!", None, "the " * 5000]
    rows = [(i // 2 if i > 3 else None, t) for i, t in enumerate(texts)]
    found = align.align(documents(rows, extra=True).repartition(3), A, B, chunk_chars=chunk).collect()
    plain = [(k, plainly(t, *sides)) if len(t or "") < 2000 else (k, None) for k, t in rows]
    long = align.Aligner(A, B)([texts[-1]])
    holds = Counter(p for _, w in plain if w for p in set(w[2])) + Counter({(x // 32000, x % 32000): 1 for x in set(long[2].tolist())})
    top = defaultdict(int)
    for (a, _), n in holds.items():
        top[a] = max(top[a], n)
    want = [(k, w[0], w[1], len(w[3]), len(w[2]), sum(holds[p] == top[p[0]] for p in w[2]), sum(holds[p] for p in w[2]), hashlib.sha256(";".join(w[3]).encode()).hexdigest()) if w else (k, 0, 0, 0, 0, 0, 0, "") for k, w in plain[:-1]]
    assert sorted((tuple(r) for r in found if r["n_a"] < 2000), key=str) == sorted(want, key=str)
    assert len(found) == len(rows)
    assert align.align(documents([]), A, B).count() == 0
