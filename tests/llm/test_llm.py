"""The training-data operators against brute force on small tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.llm import embeddings, fingerprints, minhash, mixing, packing, quality, repeats, rollups, sharding, surrogates
from tidemark.llm.components import components
from tidemark.llm.workers import importable

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sp(spark):
    return importable(spark)


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return [f"w{k}" for k in rng.integers(0, vocabulary, n)]


@pytest.fixture(scope="module")
def docs(sp):
    """Copies, near copies, nulls, empty, blank, tiny and long texts, repeated and id-less rows, a clashing column."""
    base, other = prose(1, 300), prose(2, 300)
    near = base[:150] + ["changed"] + base[151:]
    texts = ["", None, "  \n ", "one two", "one two", " ".join(base), " ".join(base), " ".join(near), " ".join(other),
             " ".join(prose(3, 6000)), "Ünï ☃ " + " ".join(other[:80]), "word " * 500]
    rows = [(k, t, "en" if k % 2 else None, [None, "a", "b", "é"][k % 4], 7) for k, t in enumerate(texts)]
    rows += [rows[5], (None, "no id here", "en", "a", 1)]
    return sp.createDataFrame(rows, DOCS).withColumn("size", F.lit("mine")).repartition(3)


def empty(sp):
    return sp.createDataFrame([], DOCS)


def plain(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


# --- sharding
def test_table_is_filled_by_turns():
    owner = sharding.fill_table(["a", "b", "c"], 11)
    assert sorted(collections.Counter(owner).values()) == [3, 4, 4]
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 10)


def test_losing_a_shard_moves_few_slots():
    names = [f"s{k}" for k in range(20)]
    size = sharding.next_prime(2_000)
    before, after = sharding.fill_table(names, size), sharding.fill_table(names[:-1], size)
    moved = sum(a != b for a, b in zip(before, after) if a != 19)
    assert moved / size < 0.15


def test_shards_and_hot_keys(sp, docs):
    got = sharding.assign_shards(docs.withColumn("shard", F.lit(9)), ["doc_id"], ["x", "y", "z"]).collect()
    assert len(got) == 14 and {r.shard for r in got} <= {0, 1, 2}
    assert sharding.assign_shards(empty(sp), ["doc_id"], ["x"]).count() == 0
    hot = sp.range(1000).select(F.when(F.col("id") < 600, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    split = sharding.split_hot_keys(hot, "k", 10, F.col("id")).groupBy("k").agg(F.countDistinct("part_of_key").alias("n"))
    assert {r.k: r.n for r in split.collect()}["hot"] == 6


# --- repeated strings
def test_repeats_match_brute_force(docs):
    length = 400
    texts = [(i, t.encode()) for i, t in plain(docs)]
    seen = collections.Counter(t[k: k + length] for _, t in texts for k in range(len(t) - length + 1))
    want = []
    for i, t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - length + 1):
            if seen[t[k: k + length]] > 1:
                gone[k: k + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        want.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in repeats.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_repeats_of_nothing(sp):
    assert repeats.remove_repeats(empty(sp)).count() == 0


def test_what_is_left_shows_planted_passages(sp, monkeypatch):
    """Passages of over 50 words leave the texts that share them, clean texts stay; a cut character is marked."""
    monkeypatch.setattr(repeats, "SLICE", 2_000)
    passages = [" ".join(prose(90 + k, 110 + k)) for k in range(4)]
    own = [" ".join(prose(100 + k, 60 + k, 10**9)) for k in range(26)]
    rows = [(k, f"{own[k]} {k} {passages[k % 4]} {k} {own[k + 8]}") for k in range(8)] + [(k, own[k]) for k in range(16, 24)]
    rows += [(30, f"{own[24]}\u00e9{passages[0]}"), (31, f"{own[25]}\u0129{passages[0]}"), (32, None)]  # both end in byte A9
    docs = sp.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    spans = {r.doc_id: r for r in repeats.cut_repeats(docs).collect()}
    assert got.keys() == spans.keys() == {k for k, _ in rows}
    for k, text in rows:
        data = (text or "").encode()
        left = b"".join(data[a:b] for a, b in zip([0, *(s.end for s in spans[k].spans)], [*(s.start for s in spans[k].spans), len(data)]))
        assert left == bytes(spans[k].kept) and hashlib.sha256(left).hexdigest() == got[k].kept_sha256
        assert got[k].text == left.decode(errors="replace")
        assert got[k].n_bytes == len(data) and got[k].n_removed == len(data) - len(left) and got[k].n_spans == len(spans[k].spans)
        if k < 8:
            assert got[k].text == f"{own[k]} {k}{k} {own[k + 8]}"
        elif k < 30 or text is None:
            assert got[k].text == (text or "")
    assert got[30].text == f"{own[24]}\ufffd" and got[31].text == f"{own[25]}\ufffd"


# --- fingerprints
def test_fingerprints(sp, docs):
    got = fingerprints.compare_with_next(docs).collect()
    assert len(got) == 14 and fingerprints.compare_with_next(empty(sp)).count() == 0
    by = {(r.doc_id, r.n_chars): r for r in got}
    texts = dict(plain(docs))
    for k in range(11):  # ids 0 to 10 are followed by the next id; 5 also by its own copy
        edited = {fingerprints.edited_text(texts[k], texts[m]) for m in (k, k + 1)}
        row = by[(k, len(texts[k]))]
        assert row.edited_sha256 in {hashlib.sha256(e.encode()).hexdigest() for e in edited}
    assert by[(6, len(texts[6]))].fingerprint == by[(5, len(texts[5]))].fingerprint
    assert by[(0, 0)].near_next == 1.0 and all(0 <= r.near_edited <= 1 for r in got)


def test_chunks_resist_shifts():
    text = " ".join(prose(8, 3000)).encode()
    a, b = fingerprints.fingerprint(text), fingerprints.fingerprint(b"inserted " + text)
    assert fingerprints.containment(a, b) > 0.95 and fingerprints.chunk_ends(text)[-1] == len(text)


# --- packing
def test_packing_round_trip(sp, docs):
    from tokenizers import Tokenizer

    files = packing.public_files()
    whole = Tokenizer.from_file(files[0])
    got = packing.pack(docs, files).collect()
    texts = {i: t for i, t in plain(docs)}
    ids = {i: whole.encode(t, add_special_tokens=False).ids + [2] for i, t in texts.items()}
    assert sum(r.length for r in got) == sum(len(ids[i]) for i, _ in plain(docs))
    for r in got:
        part = np.array(ids[r.doc_id][r.start: r.start + r.length], dtype="<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(part) and r.length <= 1024
        assert r.length == 1024 or r.piece == 0
    filled = collections.defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(empty(sp), files).count() == 0


def test_texts_equal_the_tokenizer_file():
    encode = packing.encoder(*packing.public_files())
    for t in ["", " a  b\n\n c\t", "it's <|endoftext|> é 12", "x\r\ny ", "☃☃ don't"]:
        want = np.array(encode.whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert encode(t) == want


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(4)
    small = collections.Counter(rng.integers(1, 1025, 3000).tolist())
    long = collections.Counter(rng.integers(300, 1001, 50_000).tolist())
    lone = collections.Counter([*rng.integers(600, 1001, 5000).tolist(), *rng.integers(5, 200, 2500).tolist()])
    for stock in ({int(n): int(c) for n, c in zip(range(1, 1024), rng.integers(1, 40, 1023))}, small, long, lone, {1024: 3}, {1: 1}):
        used = collections.Counter()
        plan = packing.plan_sequences(dict(stock))
        for pattern, times in plan:
            assert times > 0 and sum(n * m for n, m in pattern) <= 1024
            for n, m in pattern:
                used[n] += m * times
        assert used == collections.Counter(stock)
        lengths, counts = np.array(list(stock)), np.array(list(stock.values()))
        # Pieces of over 1024 - x tokens need a sequence each, beside which none of x tokens or more fits.
        bound = max(sum(c * (1024 if n > 1024 - x else n if n >= x else 0) for n, c in zip(lengths, counts)) / 1024 for x in range(513))
        assert sum(t for _, t in plan) <= 1.006 * bound + 2
    assert packing.plan_sequences({}) == []


# --- mixing
def best_mix(size, target, texts):
    """Whole passes and the best sum of texts that does not pass the target."""
    passes = min(int(target // size), 2) if size else 0
    rest, sums = round(target - passes * size), {0}
    for n in texts:
        sums |= {x + n for x in sums if x + n <= rest}
    return passes * size + max(sums)


def test_mix(sp, docs):
    got = mixing.mix_sources(docs).collect()
    sizes, source = collections.Counter(), {}
    for r in docs.collect():
        source[r.doc_id] = r.source
        sizes[r.source] += len((r.text or "").encode().split())
    weights = dict(zip(sorted(s for s in sizes if s is not None) + [None], [3, 1, 2, 3]))
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level > 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2.0 * sizes[s] if full else weights[s] * level
        if not full:
            break
        left -= sum(target[s] for s in full)
        open_ -= full
    taken, texts = collections.Counter(), collections.defaultdict(list)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and r.taken <= 2 * r.size
        taken[s] += r.taken
        texts[s].append(r.size)
    assert all(taken[s] == best_mix(sizes[s], target[s], texts[s]) for s in taken)
    assert mixing.mix_sources(empty(sp)).count() == 0
    again = mixing.mix_sources(docs.repartition(5)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


@pytest.mark.parametrize("budget", [0, 1, 77, 5_000, 20_000])
def test_fit_is_exact_where_lengths_allow(budget):
    lengths, counts = np.arange(1, 60), np.full(59, 30)
    take = mixing.fit_lengths(lengths, counts, budget)
    assert (take * lengths).sum() == budget and (take <= counts).all() and (take >= 0).all()


# --- rollups
def test_rollups_are_idempotent(sp, tmp_path):
    cols = "kind string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"
    one = sp.createDataFrame([("insert", "a", None, "t", 5, None), ("insert", "a", None, "t", None, None), ("insert", "b", "x", "t", 7, None)], cols)
    two = sp.createDataFrame([("revise", "a", None, "t", 9, 5), ("delete", "b", "x", "t", None, 7)], cols)
    for changes, name in ((one, "1"), (two, "2/x"), (one, "1"), (sp.createDataFrame([], cols), "3")):
        rollups.commit(changes, f"file://{tmp_path}/ledger", name)
    assert [tuple(r) for r in rollups.totals(sp, f"file://{tmp_path}/ledger").collect()] == [("a", None, "t", 2, 9)]
    rollups.compact(sp, f"file://{tmp_path}/ledger")
    rollups.commit(two, f"file://{tmp_path}/ledger", "2/x")  # a replay after the folding still replaces
    assert [tuple(r) for r in rollups.totals(sp, f"file://{tmp_path}/ledger").collect()] == [("a", None, "t", 2, 9)]
    with pytest.raises(Exception, match="unknown kind"):
        rollups.signed_totals(sp.createDataFrame([("odd", "a", "x", "t", 1, 1)], cols)).collect()


def test_token_totals_equal_plain_counts(sp):
    """The query's totals: all documents with an end token each, exact copies (null texts too) left out but one."""
    from tidemark.llm.queries import token_totals

    rows = [(k, t, "en" if k % 2 else None, ["a", None][k % 3 == 0], 0) for k, t in enumerate(["one two", "one two", None, None, "", "Ünï ☃", "x " * 3000, "one two"])]
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in token_totals(sp.createDataFrame(rows, DOCS)).collect()}
    encode = packing.encoder(*packing.public_files()).ordinary
    want, seen = collections.Counter(), set()
    docs_of = collections.Counter()
    for _, t, lang, source, _ in rows:
        if t not in seen:
            for name, n in (("words-1", len((t or "").split())), ("byte-bpe-50k-1", len(encode(t or "")) + 1)):
                want[source, lang, name] += n
                docs_of[source, lang, name] += 1
        seen.add(t)
    assert got == {k: (docs_of[k], want[k]) for k in docs_of}


# --- embeddings
def test_links_match_brute_force(sp):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    x[50:150] = x[0] + rng.normal(scale=0.08, size=(100, 16))  # around one centre
    x[150:200] = x[1] + rng.normal(scale=0.35, size=(50, 16))  # pairs on both sides of the limit
    x[200:210] = x[2]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    rows += [(300, None), (301, [0.0] * 16), (302, [None] + [1.0] * 15), (303, [float("nan")] * 16), (304, [1.0, 2.0])]
    df = sp.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    got = {r.vec_id: r for r in embeddings.link_vectors(df).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    assert sum(got[k].n_links for k in range(300)) >= 0.9 * near.sum()
    assert all(got[k].n_links <= near[k].sum() for k in range(300))
    assert got[205].component_id == 2 and got[100].component_id == 0 and not got[100].kept
    assert all(got[k].n_links == 0 and got[k].kept for k in range(300, 305))


def test_no_link_is_lost_with_many_lists(sp, monkeypatch):
    """Pairs just over the limit, and members of wide cells, in vectors without clusters."""
    monkeypatch.setattr(embeddings, "LEAST_GROUP", 128, raising=False)
    rng = np.random.default_rng(11)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    base = unit(rng.normal(size=(1500, 64)))
    side = rng.normal(size=base.shape)
    side = unit(side - (side * base).sum(axis=1)[:, None] * base)
    pair = 0.902 * base + np.sqrt(1 - 0.902 ** 2) * side
    wide = unit(np.repeat(unit(rng.normal(size=(60, 64))), 12, axis=0) + rng.normal(size=(720, 64)) * 0.05)
    x = np.concatenate([base, pair, wide])
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    got = {r.vec_id: r.n_links for r in embeddings.link_vectors(sp.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    assert near.sum() > 3000
    assert [got[k] for k in range(len(x))] == near.sum(axis=1).tolist()


# --- surrogates
def test_surrogates(sp, docs):
    text = ("Frau Anna Schmidt wrote to a.b@mail9.example.com and A.B@mail9.example.com, called +1 (456) 555-2186, paid by "
            "4041894974608795 or 4041-8949-7460-8795 from 42.144.35.254; Mr. John Doe, г-н Иван; version 2.0. and 1999.")
    df = sp.createDataFrame([(1, text, "x"), (2, text, "y"), (3, None, "z"), (4, "", "z"), (5, "clean words", "z")], "doc_id long, text string, row string")
    got = {r.doc_id: r for r in surrogates.replace_personal_data(df).collect()}
    new = got[1].text
    assert new == got[2].text and got[3].text is None and got[4].text == "" and got[5].text == "clean words" and got[1].row == "x"
    for secret in ("Anna", "Schmidt", "a.b@", "555-2186", "4041894974608795", "42.144.35.254", "John", "Иван"):
        assert secret not in new
    assert "version 2.0. and 1999." in new and got[1].n_entities == 9
    found = {k: [t for _, _, kind, t in surrogates.found(new) if kind == k] for k in ("card", "email", "ip", "name-f", "name-m")}
    assert len({surrogates.canonical("card", t) for t in found["card"]}) == 1 and len(found["name-m"]) == 2
    assert len(set(found["email"])) == 1 and len(found["ip"]) == 1
    assert surrogates.replace_personal_data(docs).columns == [*docs.columns, "n_entities"]


def test_colliding_surrogates_draw_again(sp, monkeypatch):
    rows = [("ssn", f"{k:03d}-00-0000") for k in range(40)]
    got = surrogates.distinct_surrogates(sp.createDataFrame([(1, *r) for r in rows], "doc_id long, kind string, entity string"))
    pairs = got.collect()
    assert len(pairs) == 40 == len({r.surrogate for r in pairs}) and not {r.surrogate for r in pairs} & {e for _, e in rows}
    short = sp.createDataFrame([(1, "pin", str(k)) for k in range(5)], "doc_id long, kind string, entity string")
    few = surrogates.distinct_surrogates(short).collect()  # five one-digit entities leave five free digits
    assert sorted(r.entity for r in few) == list("01234") and sorted(r.surrogate for r in few) == list("56789")


def test_crowded_shapes_end(sp, monkeypatch):
    """Eight, then all ten one-digit numbers: distinct surrogates, never the own value."""
    monkeypatch.setattr(surrogates, "ROUNDS", 5)
    for n in (8, 10):
        rows = sp.createDataFrame([(1, "pin", str(k)) for k in range(n)] + [(1, "name-m", "Doe")], "doc_id long, kind string, entity string")
        got = surrogates.distinct_surrogates(rows).collect()
        assert len(got) == n + 1 == len({(r.kind, r.surrogate) for r in got}) and all(r.entity != r.surrogate for r in got)
        free = [r for r in got if r.kind == "pin" and r.attempt < surrogates.ROUNDS]
        assert all(int(r.surrogate) >= n for r in free) and len(free) <= 10 - n
    assert surrogates.shape("card", "4041894974608795") != surrogates.shape("card", "4041894974608796")
    assert surrogates.shape("phone", "+33|12") != surrogates.shape("phone", "+44|12")


def test_entities_of_texts_are_all_replaced(sp, docs):
    """Counts of the query equal those of the plain finder, and no found text stands in the result."""
    texts = {r.doc_id: r.text for r in sp.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in surrogates.replace_personal_data(sp.read.parquet(f"{SF}/documents.parquet")).collect()}
    for i, text in texts.items():
        seen = surrogates.found(text or "")
        assert got[i].n_entities == len(seen) and (got[i].text == text) == (not seen)
        assert all(t not in got[i].text for _, _, _, t in seen)


def test_more_names_than_short_surrogates(sp):
    """A Greek name has 2,187 short surrogates for a gender."""
    words = ["".join("αβγδεζηθ"[k // 8 ** j % 8] for j in range(4)).capitalize() for k in range(3000)]
    drawn = {surrogates.surrogate(surrogates.KEY, "name-m", w, a) for w in words for a in range(4)}
    assert len(drawn) > 4 * 2187
    rows = [(1, "name-m", w) for w in words]
    got = surrogates.distinct_surrogates(sp.createDataFrame(rows, "doc_id long, kind string, entity string")).collect()
    assert len(got) == 3000 == len({r.surrogate for r in got}) and not {r.surrogate for r in got} & set(words)


def test_bare_mentions_and_other_shapes(sp):
    shapes = ["+33 1 23 45 67 89", "+49 30 123456", "+44 7911 123456", "07911 123456", "555-1234", "3782 822463 10005",
              "2001:db8::8a2e:370:7334", "fe80:0:0:0:0:0:0:1"]
    text = ("Earlier Doe came. Mr. John Doe wrote. Later John Doe paid, Doe's son and Mr Doe and Dr Doe too; Herr Prof. Karl Weiß "
            "and Dr. Maria Roe left. Roe slept, Karl read at 12:30:45 by std::sort. " + "; ".join(shapes) + ".")
    df = sp.createDataFrame([(1, text), (2, "John and Doe without titles.")], "doc_id long, text string")
    got = {r.doc_id: r for r in surrogates.replace_personal_data(df).collect()}
    new = got[1].text
    for secret in ["John", "Doe", "Karl", "Weiß", "Maria", "Roe", *shapes]:
        assert secret not in new
    words = new.replace("'", " ").replace(".", " ").replace(",", " ").replace(";", " ").split()
    first, last = words[words.index("Mr") + 1: words.index("wrote")]
    assert new.startswith(f"Earlier {last} came. Mr. {first} {last} wrote. Later {first} {last} paid, {last}'s son and Mr {last} and Dr {last} too;")
    assert "12:30:45 by std::sort" in new and got[2].text == "John and Doe without titles." and got[1].n_entities == 10 + len(shapes)


# --- quality
def test_quality_held_out(sp):
    docs, labels = (sp.read.parquet(f"{SF}/{t}.parquet").select(*c) for t, c in (("documents", ["doc_id", "text"]), ("labels", ["doc_id", "quality"])))
    scored = quality.score_quality(docs, labels).select("row.doc_id", "held_out", "score", "predicted")
    got = scored.join(labels, "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() >= 0.8 and got["score"].between(0, 1).all()
    assert set(got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]) == {True}


def test_quality_without_labels(sp, docs):
    none = sp.createDataFrame([], "doc_id long, quality int")
    got = quality.score_quality(docs, none).collect()
    assert len(got) == 14 and {r.score for r in got} == {0.5}
    assert quality.score_quality(empty(sp), none).count() == 0


# --- MinHash
def shingles(text):
    w = text.encode().split()
    return collections.Counter(tuple(w[i: i + 5]) for i in range(max(len(w) - 4, 1))) if w else collections.Counter()


def test_signature_estimates_weighted_jaccard():
    a = collections.Counter({k: 1 + k % 7 for k in range(300)})
    b = collections.Counter({k: 1 + k % 5 for k in range(60, 360)})
    mixed = [np.sort(minhash.mix(np.array([k for k, n in c.items() for _ in range(n)], dtype=np.uint64))) for c in (a, b)]
    sig = minhash.signatures(np.concatenate(mixed), np.array([0, len(mixed[0]), len(mixed[0]) + len(mixed[1])]), 2_000)
    want = sum((a & b).values()) / sum((a | b).values())
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04 and minhash.overlap(*mixed) == pytest.approx(want)
    assert minhash.overlaps([mixed[0]], [mixed[1]])[0, 0] == pytest.approx(want)


def plain_classes(rows):
    """Group number of every (id, text) by links between any two of them."""
    sets = [shingles(t or "") for _, t in rows]
    group = list(range(len(rows)))
    links = [(i, j) for i in range(len(rows)) for j in range(i)
             if sets[i] == sets[j] or (sets[i] and sum((sets[i] & sets[j]).values()) >= 0.8 * sum((sets[i] | sets[j]).values()))]
    for _ in rows:
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
    return group


@pytest.fixture(scope="module")
def copies(sp, docs):
    """Rows of ``docs`` and a chain of near copies, some under one id, some without an id, some repeated."""
    family = [" ".join(w if (k + s) % 37 else f"e{s}" for k, w in enumerate(prose(9, 400))) for s in range(0, 36, 3)]
    ids = [100, 101, 100, None, None, 105, 106, 7, 7, 109, None, 111]
    rows = [(k, t, None, None, None) for k, t in zip(ids, family)]
    rows += [(None, "alone and nameless " * 9, None, None, 1), (None, "alone and nameless " * 9, None, None, 2), rows[0], rows[4], rows[4]]
    more = sp.createDataFrame(rows, DOCS)
    return docs.select(*more.columns).unionAll(more)


def test_near_duplicates_match_brute_force(sp, copies):
    rows = [(r.doc_id, r.text) for r in copies.collect()]
    group = plain_classes(rows)
    least = {g: min((i for (i, _), h in zip(rows, group) if h == g and i is not None), default=None) for g in group}
    got = sorted(((r.doc_id, r.class_id, r.n_shingles, r.kept) for r in minhash.near_duplicates(copies).collect()), key=repr)
    assert got == sorted(((i, least[g], sum(shingles(t or "").values()), i == least[g]) for (i, t), g in zip(rows, group)), key=repr)
    assert minhash.near_duplicates(empty(sp)).count() == 0


def test_one_row_of_each_class_stays(sp, copies):
    rows = [(r.doc_id, r.text) for r in copies.collect()]
    group = dict(zip([repr(r) for r in rows], plain_classes(rows)))
    least = {g: min((i for i, _ in rows if i is not None and any(group[repr((i, t))] == g for j, t in rows if j == i)), default=None)
             for g in group.values()}
    kept = minhash.one_of_each(copies)
    assert kept.columns == copies.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(group[repr(r)] for r in got) == sorted(set(group.values()))
    assert all(i == least[group[repr((i, t))]] for i, t in got)


def test_components(sp):
    chain = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.id: r.component for r in components(sp.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[150] == got[200] == 100 and len(got) == 44


# --- pipeline
def test_pipeline_stages(sp):
    """Every stage by itself, on what its predecessor kept, against a plain version."""
    import corpus_pipeline as P

    docs = sp.read.parquet(f"{SF}/documents.parquet")
    good, one, clean, mixed, packed = (stage for _, stage in P.STAGES)
    rows = lambda df: sorted(map(repr, df.collect()))
    first = good(sp, docs, SF)
    scores = quality.score_quality(docs, sp.read.parquet(f"{SF}/labels.parquet")).select("row.doc_id", "predicted").collect()
    stay = {r.doc_id for r in scores if r.predicted == 1}
    assert rows(first) == rows(docs.filter(F.col("doc_id").isin(list(stay)))) and first.columns == docs.columns
    labels = {r.doc_id: r.quality for r in sp.read.parquet(f"{SF}/labels.parquet").collect()}
    assert np.mean([(r.predicted == 1) == (labels[r.doc_id] == 1) for r in scores if r.doc_id in labels]) > 0.9

    second = one(sp, first, SF)
    plain_rows = [(r.doc_id, r.text) for r in first.collect()]
    least = {}
    for (i, _), g in zip(plain_rows, plain_classes(plain_rows)):
        least[g] = min(least.get(g, i), i)
    assert rows(second) == rows(first.filter(F.col("doc_id").isin(list(least.values())))) and second.columns == docs.columns

    third = clean(sp, second, SF)
    before, after = {r.doc_id: r for r in second.collect()}, {r.doc_id: r for r in third.collect()}
    changed = {r.doc_id for r in surrogates.replace_personal_data(second).filter("n_entities > 0").collect()}
    assert before.keys() == after.keys() and third.columns == docs.columns
    assert {i for i in before if before[i].text != after[i].text} == changed
    for i in changed:  # nothing that was found stands in the result
        for kind, match in surrogates_found(before[i].text):
            assert match not in after[i].text, (i, kind)

    fourth = mixed(sp, third, SF)
    taken = collections.Counter(r.doc_id for r in fourth.collect())
    assert fourth.columns == docs.columns and taken == {r.doc_id: r.times for r in mixing.mix_sources(third).collect() if r.times}
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in after.items()}
    for size, target, words, texts in by_source(mixing.mix_sources(third).collect(), after).values():
        assert 0 <= best_mix(size, target, texts) - words <= 0.005 * target
    assert sum(sizes.values()) == sum(r.size for r in mixing.mix_sources(third).collect())

    last = packed(sp, fourth, SF).collect()
    pieces = collections.Counter((r.doc_id, r.piece) for r in last)
    assert {i for i, _ in pieces} == set(taken) and all(n == taken[i] for (i, _), n in pieces.items())
    whole = collections.defaultdict(list)
    for r in last:
        whole[r.sequence_id].append((r.offset, r.length))
    for placed in whole.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted((r.doc_id, r.piece) for r in P.run(sp, SF).collect()) == sorted((r.doc_id, r.piece) for r in last)


def surrogates_found(text):
    """Plain patterns of what must not stay: mail addresses and social security numbers."""
    for kind, pattern in (("mail", r"[\w.+-]+@[\w-]+\.[\w.-]*\w"), ("ssn", r"\b\d{3}-\d{2}-\d{4}\b")):
        for match in re.findall(pattern, text):
            yield kind, match


def by_source(planned, rows):
    """Size, target, taken words and the texts' sizes of every source."""
    out = {}
    for r in planned:
        size, target, words, texts = out.get(rows[r.doc_id].source, (r.source_size, r.target, 0, []))
        out[rows[r.doc_id].source] = (size, target, words + r.taken, [*texts, r.size])
    return out


def test_mixed_rows_with_ties_at_the_limit(sp):
    """Repeated rows share a draw: as many of them are taken as the plan says."""
    rows = [(1, "a b c", "en", "s", 1)] * 7 + [(2, "a b c", "en", "s", 2)] * 5 + [(3, None, "en", None, 3), (None, "x y z", None, "t", 4)] * 2
    docs = sp.createDataFrame(rows, DOCS)
    for share in (0.3, 0.9, 1.4):
        plan = collections.Counter()
        for r in mixing.mix_sources(docs, total_share=share).collect():
            plan[r.doc_id] += r.times
        got = collections.Counter(r.doc_id for r in mixing.mixed_rows(docs, total_share=share).collect())
        assert got == {k: n for k, n in plan.items() if n}
    assert mixing.mixed_rows(empty(sp)).count() == 0
