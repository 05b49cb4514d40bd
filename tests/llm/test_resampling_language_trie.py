"""Importance resampling, language identification and the conversation trie against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.llm import importance, language, trie
from tidemark.llm.queries import LLM_ORACLES, LLM_QUERIES
from tidemark.llm.workers import importable

DOCS = "doc_id long, text string, lang string, source string, score long, rank string"


@pytest.fixture(scope="module")
def sp(spark):
    return importable(spark)


@pytest.fixture(scope="module")
def docs(sp):
    rng = random.Random(4)
    prose = lambda n, size=60: " ".join(f"w{rng.randrange(size)}" for _ in range(n))
    texts = [None, "", " .,; ", "Ünï ☃☃ ÅB Åb ab AB", prose(30), prose(30), prose(25), prose(4000), "x" * 5000, "a" * 31 + " " + "a" * 32,
             *(prose(20 + k) for k in range(40))]
    rows = [(k, t, "en", None if k % 3 else "a", 5, "mine") for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, prose(22), None, "b", 1, "x"), (None, None, None, None, None, None)]
    return sp.createDataFrame(rows, DOCS).repartition(3)


# --- importance resampling
def plain_features(text, n):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    return words, [b" ".join(words[i: i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain_resample(rows, target, n, buckets, percent, min_words):
    count = lambda texts: collections.Counter(zlib.crc32(f) % buckets for t in texts for f in plain_features(t, n)[1])
    s, t = count([r.text for r in rows]), count(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for r in rows:
        words, found = plain_features(r.text, n)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in found)
        h = int(hashlib.sha256(f"2024:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        out.append([r.doc_id, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    ready = sorted((o for o in out if o[1] >= min_words), key=lambda o: (-o[4], o[0] is None, o[0] or 0, o[2]))
    for k, o in enumerate(ready[: percent * len(ready) // 100]):
        o[5] = k + 1
    return sorted(map(repr, out))


@pytest.mark.parametrize("n, buckets, percent", [(1, 10_000, 10), (3, 97, 50), (2, 1, 100)])
def test_resampling_equals_plain_python(sp, docs, n, buckets, percent):
    target = ["w1 w2 w3 W4", None, "", "Ünï unseen " + "w5 " * 50]
    got = importance.resample(docs, sp.createDataFrame([(t,) for t in target], "text string"), n, buckets, percent).collect()
    assert sorted(repr([*r]) for r in got) == plain_resample(docs.collect(), target, n, buckets, percent, 20)


def test_resampling_of_nothing(sp, docs):
    nothing = sp.createDataFrame([], DOCS)
    assert importance.resample(nothing, docs).count() == 0
    got = importance.resample(docs, nothing).collect()
    assert len(got) == docs.count() and all(r.weight is not None for r in got)


def test_interning_verifies_bytes(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    starts = rng.integers(0, 2900, 4000)
    ends = starts + rng.integers(1, 90, 4000)
    spans = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert importance.span_keys(data, starts, ends).tolist() == [xxhash.xxh64_intdigest(s) for s in spans]
    for keys in (importance.span_keys, lambda d, s, e: np.full(len(s), 7, dtype=np.uint64) + (e - s > 40).astype(np.uint64)):
        monkeypatch.setattr(importance, "span_keys", keys)  # the second: nearly all keys collide
        few = slice(0, 4000 if keys is importance.span_keys else 300)
        slot, owner = importance.intern(data, starts[few], ends[few])
        by_slot = collections.defaultdict(set)
        for s, span in zip(slot.tolist(), spans[few]):
            by_slot[s].add(span)
        assert all(len(v) == 1 for v in by_slot.values()) and len(by_slot) == len(set(spans[few])) == (owner >= 0).sum()


def test_blocks_do_not_change_counts(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(["a b c d e f g", None, "a b", "h " * 40, ""])], names=["text"])
    whole = [b.to_pydict() for b in importance._count(3, 50)(iter([batch]))]
    monkeypatch.setattr(importance, "AT_ONCE", 4)
    assert [b.to_pydict() for b in importance._count(3, 50)(iter([batch]))] == whole


# --- language identification
def test_language_of_held_out_texts(sp):
    docs = sp.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 200 and (got["lang"] == got["lang_pred"]).mean() > 0.98
    kept = got[~got["rejected"]]
    assert len(kept) > 0.9 * len(got) and (kept["lang"] == kept["lang_pred"]).mean() >= 0.98
    assert got["score"].between(0, 1).all()


def test_labels_of_held_out_texts_are_not_learned(sp):
    docs = sp.read.parquet(f"{SF}/documents.parquet")
    wrong = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang"))) \
        .withColumn("source", F.lit("other"))
    assert sorted(language.identify(docs).collect()) == sorted(language.identify(wrong.repartition(5)).collect())


def test_language_of_odd_rows(sp):
    rows = [(k, ("the of and " if k % 2 else "der die und ") * (k % 7 + 1), "en" if k % 2 else "de", k) for k in range(80)]
    rows += [(100, None, "en", 1), (101, "", "en", 1), (102, "123 -- 4½", "en", 1), (103, "ß", "de", 1), (None, "the of and the", "xx", 1),
             (104, "the " * 200_000, None, 1), (105, "😀 der", None, 1), rows[1], rows[1]]
    docs = sp.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    got = collections.defaultdict(list)
    for r in language.identify(docs).collect():
        got[r.doc_id].append(r)
    assert [(got[k][0].lang_pred, got[k][0].score, got[k][0].rejected) for k in (100, 101, 102)] == [("und", 0.0, True)] * 3
    assert got[104][0].lang_pred == "en" and got[None][0].lang_pred == "en" and not got[None][0].held_out
    assert got[105][0].lang_pred == "de" and len(got[1]) == 3 and len(set(got[1])) == 1
    only = language.identify(docs.filter("lang = 'de'")).collect()
    assert {(r.lang_pred, r.score) for r in only} == {("de", 1.0)}
    none = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert language.identify(docs.limit(0)).count() == 0


def test_subwords():
    rows, of, has = language.subwords(["ab", "", "7", "AB", "a b"])
    by_text = [sorted(rows[of == k].tolist()) for k in range(5)]
    assert by_text[0] == by_text[3] and [len(b) for b in by_text] == [6, 0, 0, 6, 6] and has.tolist() == [True, False, False, True, True]


# --- conversation trie
def plain_trie(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            turns[conv].append(((turn is not None, turn or 0, role, key), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in turns.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:])
    members = collections.defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in m if full[c] == p).encode()).hexdigest()) for p, m in members.items()), key=repr)


def random_turns(seed, n):
    """Conversations with shared beginnings, a third of them copies of one, gaps, ties, nulls and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for c in range(-30, n):
        if rng.random() < 0.1:
            continue
        if rng.random() < 0.33:
            rows += [(c, k, "user", f"copy {k}", 0, "x") for k in range(8)]
            continue
        for k in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, k if rng.random() < 0.9 else None, rng.choice(["user", None, ""]), rng.choice(["hi", "é☃", "", None, "more"]), 0, "x"))
    rows += [rows[3], rows[3], (None, 1, "user", "nobody's", 0, "x")]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, depth long, turns string"


@pytest.mark.parametrize("seed, n, parts", [(1, 60, 1), (2, 300, 8), (3, 700, 97)])
def test_trie_equals_plain_python(sp, monkeypatch, seed, n, parts):
    rows = random_turns(seed, n)
    before = {k: sp.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    sp.conf.set("spark.sql.shuffle.partitions", parts)
    sp.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = trie.prefix_trie(sp.createDataFrame(rows, SCHEMA)).collect()
    finally:
        for k, v in before.items():
            sp.conf.set(k, v)
    assert sorted((tuple(r) for r in got), key=repr) == plain_trie(rows)


def test_trie_of_little(sp):
    assert trie.prefix_trie(sp.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, None, None, None, None)]  # its only turn falls away
    assert sorted(tuple(r) for r in trie.prefix_trie(sp.createDataFrame(rows, SCHEMA)).collect()) == plain_trie(rows)
    rows = [(0, k, "user", "long " * 50_000 if k == 5 else "t", 0, "") for k in range(2_000)]
    assert sorted((tuple(r) for r in trie.prefix_trie(sp.createDataFrame(rows, SCHEMA)).collect()), key=repr) == plain_trie(rows)


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op13_conversation_trie"])
def test_queries_match_sql(sp, name):
    from check_queries import compare, connect

    assert compare(LLM_QUERIES[name](sp, SF), connect(SF), LLM_ORACLES[name]) == ""
