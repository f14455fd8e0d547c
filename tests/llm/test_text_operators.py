import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blockcat.llm import calibration, common, components, exact_dedup, licenses, mixing, packing, quality, secrets, simhash, token_files, tokens, toxicity, vectors
from blockcat.operators import shared

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key int, size string, _id int, _plan int"


def table(spark, rows):
    """Documents with extra columns named like those used inside."""
    return spark.createDataFrame([(i, t, None, s, None, "x", 1, "y", 2, 3) for i, t, s in rows], SCHEMA)


WORDS = "the of and password token apple river stone cc by all rights reserved naïve straße 日本 ! ? ,".split()


def odd_rows(seed=0, n=60):
    """Nulls, empty, long, equal and repeated texts over a hot source."""
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(0, 40))), rng.choice(["a", "a", "a", "b", None])) for i in range(n)]
    rows += [(1000, None, "a"), (1001, "", "a"), (1002, "", None), (1003, " \n\t ", "b"), (1004, "long " * 30_000, "a"), (1005, "x" * 20_000, "c")]
    rows += [(1200 + i, "copy of one text", "a") for i in range(25)]
    return rows


def components_of(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return [root(i) for i in range(n)]


# --- exact dedup


def test_exact_dedup(spark):
    rows = odd_rows()
    by = defaultdict(list)
    for i, t, _ in rows:
        by[t or ""].append(i)
    got = exact_dedup.duplicates(table(spark, rows), 4096).collect()
    assert len(got) == len(rows)
    text = {i: t or "" for i, t, _ in rows}
    for r in got:
        own = by[text[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))
        assert r.text_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    left = exact_dedup.dedup(table(spark, rows), 4096)
    assert left.columns == table(spark, rows).columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(max(v) for v in by.values())


def files_by_label(monkeypatch, module, files):
    """Notes how many files of rows each table stored by the module has."""
    own = common.Stored

    class Noted(own):
        def __init__(self, df, label):
            super().__init__(df, label)
            files[label] = sum(n > 0 for n in self.df.groupBy(F.input_file_name()).count().toPandas()["count"])

    monkeypatch.setattr(module, "Stored", Noted, raising=False)
    monkeypatch.setattr(module, "stored", lambda df, label: Noted(df, label).df)


def test_exact_dedup_writes_fewer_files_as_rows_get_fewer(spark, monkeypatch):
    files, rows = {}, [(i, f"{i % 40} " * (200 if i % 3 else 4), "a") for i in range(120)]
    files_by_label(monkeypatch, exact_dedup, files)
    got = exact_dedup.duplicates(table(spark, rows), 16).collect()
    ids = defaultdict(list)
    for i, t, _ in rows:
        ids[t].append(i)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, max(ids[t]), len(ids[t])) for i, t, _ in rows}
    assert files["blocks"] == 4 and files["names-2"] <= 3 and files["names-4"] == 1


def test_exact_dedup_of_repeated_rows_and_nulls(spark):
    rows = [(1, "a" * 300, "s"), (1, "a" * 300, "s"), (1, "b" * 300, "s"), (None, "a" * 300, "s"), (2, None, "s")]
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.duplicates(table(spark, rows), 64).collect())
    assert got == Counter({(1, 1, 3, True): 1, (1, 1, 3, False): 1, (1, 1, 1, True): 1, (None, 1, 3, False): 1, (2, 2, 1, True): 1})
    assert Counter((r.doc_id, r.text) for r in exact_dedup.dedup(table(spark, rows), 64).collect()) == Counter({(1, "a" * 300): 1, (1, "b" * 300): 1, (2, None): 1})
    assert exact_dedup.duplicates(table(spark, []).limit(0)).count() == 0


# --- mixing


def test_mixing(spark):
    rows = odd_rows(1, 200)
    got = mixing.mix(table(spark, rows)).collect()
    again = mixing.mix(table(spark, rows).repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    whole = Counter()
    for i, _, s in rows:
        whole[s] += size[i]
    names = sorted([s for s in whole if s is not None]) + [None]
    weight = dict(zip(names, (5, 2, 1, 5, 2)))
    target, open_, left = {}, set(names), 1.5 * sum(whole.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * whole[s]}
        for s in over or open_:
            target[s] = 2 * whole[s] if over else share[s]
        left -= sum(target[s] for s in (over or open_))
        open_ -= over or set(open_)
    taken = Counter()
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == whole[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)


def test_mixed_rows(spark):
    rows = odd_rows(2, 80)
    docs = table(spark, rows)
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words, text = Counter(), {i: t for i, t, _ in rows}
    for r in out.collect():
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert text[r.doc_id].startswith(r.text)
    assert words == Counter({k: v for k, v in taken.items() if v})


def test_mixing_of_nothing(spark):
    assert mixing.mix(table(spark, []).limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(table(spark, [(1, None, None), (2, "", "a")])).collect()] == [0, 0]


# --- tokens, packing, files


def test_encoder_equals_the_library():
    t, e = Tokenizer.from_file(PATH), tokens.Encoder(PATH)
    texts = [x or "" for _, x, _ in odd_rows()] + ["AÉ́ <|endoftext|>x<|ENDOFTEXT|> it's ΣΣ a\x1cb\x85c  d", "don't'll K İstanbul ẞ", "été, naïve. 中文 \U0001f600.", "a​b﻿  z", "é."]
    assert e.by_chunk and e.by_model
    for text, ids in zip(texts, e.encode([x.encode() for x in texts]), strict=True):
        assert ids == np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_encoder_forgets_what_is_too_much(monkeypatch):
    monkeypatch.setattr(tokens, "KEEP_CHUNKS", 8)
    e = tokens.Encoder(PATH)
    texts = [" ".join(f"w{i + j}" for j in range(6)) for i in range(30)]
    assert list(e.encode([x.encode() for x in texts])) == [e.encode_whole(x) for x in texts]


def test_token_files_encode_a_batch_in_slices(spark, tmp_path, monkeypatch):
    docs, rows = 3_000, []
    df = spark.range(docs).selectExpr("id as doc_id", "concat('word', id % 7) as text").coalesce(1)
    real = type(df).mapInArrow

    def noted(self, work, schema, *more):
        if "crc long" not in schema or "ids binary" not in schema:
            return real(self, work, schema, *more)
        rows.extend(b.num_rows for b in work(iter(self.toArrow().combine_chunks().to_batches())))
        return real(self, work, schema, *more)

    monkeypatch.setattr(type(df), "mapInArrow", noted)
    token_files.write_token_files(df, str(tmp_path / "t"), PATH)
    assert sum(rows) == docs and max(rows) <= 1024
    assert token_files.read_token_files(spark, str(tmp_path / "t")).count() == docs


def test_what_follows_the_encoding_forgets_it(monkeypatch):
    monkeypatch.setattr(tokens, "_encoders", {})
    e = tokens.encoder(PATH)
    text = [b"one two three", b"two one"]
    ids = list(e.encode(text))
    e.old = dict(e.new)
    sizes = []
    assert list(tokens.after_encoding(lambda batches: (sizes.append(len(e.new) + len(e.old)) or b for b in batches))(iter([1, 2]))) == [1, 2]
    assert sizes == [0, 0] and tokens.encoder(PATH) is e and list(e.encode(text)) == ids


def test_packing_holds_little(spark, monkeypatch):
    monkeypatch.setattr(tokens, "_encoders", {})
    docs, works = 3_000, {}
    df = spark.range(docs).selectExpr("id as doc_id", "concat('word', id % 7) as text").coalesce(1)
    real = type(df).mapInArrow

    def noted(self, work, schema, *more):
        works[schema.replace("`", "").replace("bigint", "long")] = (self, work)
        return real(self, work, schema, *more)

    monkeypatch.setattr(type(df), "mapInArrow", noted)
    assert packing.pack(df, PATH).count() == docs
    pieces = "doc_id long, piece int, start long, length long, ids_crc32 long"
    encoding, (dealt, totals) = works[pieces][1], works[f"{pieces}, _part int, _before long"]
    sizes = [b.num_rows for b in encoding(iter(df.toArrow().combine_chunks().to_batches()))]
    assert sum(sizes) == docs and max(sizes) <= 1024
    assert dealt.rdd.getNumPartitions() == 1  # not a task and a file for each shuffle partition
    e = tokens.encoder(PATH)
    assert e.new
    monkeypatch.setattr(shared, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    assert sum(b.num_rows for b in totals(iter(dealt.toArrow().to_batches()))) == docs
    assert not e.new and not e.old


def brute_pieces(rows, capacity):
    t = Tokenizer.from_file(PATH)
    for i, text, _ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k in range(0, len(ids), capacity):
            yield i, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())


def test_packing(spark):
    rows = [*odd_rows(), (5, "again", "a"), (None, "no id", "a")]
    got = packing.pack(table(spark, rows), PATH, 256).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(brute_pieces(rows, 256))
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= 256
    assert len(bins) <= 1.05 * sum(r.length for r in got) / 256 + 1
    assert packing.pack(table(spark, []).limit(0), PATH).count() == 0


def fewest_bins(sizes, capacity):
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for b in {x: k for k, x in enumerate(bins) if x + sizes[i] <= capacity}.values():
            place(i + 1, [*bins[:b], bins[b] + sizes[i], *bins[b + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best[0]


def test_plans_are_whole_and_reduction_costs_nothing():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.choice([10, 20, 31])
        sizes = [rng.randrange(1, capacity + 1) if rng.random() < 0.5 else rng.randrange(capacity // 4, capacity + 1) for _ in range(rng.randrange(0, 9))]
        p = packing.Planner(dict(Counter(sizes)), capacity)
        p.reduce()
        left = [s for s, n in p.left.items() for _ in range(n)]
        assert p.bins + fewest_bins(left, capacity) == fewest_bins(sizes, capacity)
        p.best_fit()
        load, seen = Counter(), defaultdict(set)
        for x in p.placements:
            for b in range(x.bins):
                for e in range(x.each):
                    seen[x.length].add(x.rank + b * x.each + e)
                    load[x.sequence + b] += x.length
        assert {s: len(v) for s, v in seen.items()} == dict(Counter(sizes))
        assert all(v <= capacity for v in load.values()) and len(load) == p.bins


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for ids in (np.zeros(0), np.array([7]), rng.integers(0, 49_408, 1000), np.full(300, 2**32 - 1), np.where(rng.random(500) < 0.05, 2**32 - 1, rng.integers(0, 9, 500))):
        ids = ids.astype(np.uint32)
        assert np.array_equal(token_files.decode_blocks(*token_files.encode_blocks(ids))[: len(ids)], ids)
    with pytest.raises(ValueError):
        token_files.decode_segment(b"x" * 80)
    one, two = (token_files.encode_segment(0, k, [k, None], [3, 0], np.array([5, 10, 10 + k], dtype=np.uint32)) for k in (0, 1))
    whole = one + b"\n" + two + b"\n"
    assert [(s[1], s[2], s[4].tolist()) for s in token_files.segments_of(whole)] == [(0, [0, None], [5, 10, 10]), (1, [1, None], [5, 10, 11])]
    with pytest.raises(ValueError):
        list(token_files.segments_of(one + two))


def test_token_files(spark, tmp_path):
    rows = [*odd_rows(), (None, "no id", "a"), (3, "again", "a")]
    t = Tokenizer.from_file(PATH)
    token_files.write_token_files(table(spark, rows), str(tmp_path / "t"), PATH, segment_ids=3000)
    got = token_files.read_token_files(spark, str(tmp_path / "t"), ids=True).collect()
    want = Counter((i, tuple([*t.encode(x or "", add_special_tokens=False).ids, 1])) for i, x, _ in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert max(len(list(token_files.segments_of(f.read_bytes()))) for f in (tmp_path / "t").glob("part-*")) > 1  # several to a file
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        start += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x)
    token_files.write_token_files(table(spark, []).limit(0), str(tmp_path / "e"), PATH)
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0


# --- SimHash


def test_fingerprints():
    for text in [x or "" for _, x, _ in odd_rows()][:66] + ["A b C d", "ab c"]:
        if len(text) > 10_000:
            continue
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in ([" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)])] if words else []
        assert simhash.fingerprint(text.encode()) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_every_pair_within_four_bits_shares_a_key():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    owns, asks = defaultdict(set), defaultdict(set)
    for out, fps in ((owns, a), (asks, b)):
        for k, p in zip(*map(np.ndarray.tolist, simhash.fuzzy_keys(fps)), strict=True):
            if out is asks or not k & 1:
                out[p].add(k >> 1)
    assert all(owns[i] & asks[i] for i in range(len(a)))


def test_near_duplicates(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = odd_rows(3) + [(3000 + i, base.replace(f"word{7 * i} ", ""), "a") for i in range(40)] + [(4000, base, "b"), (4000, "something else entirely here now", "b")]
    got = simhash.near_duplicates(table(spark, rows)).collect()
    fps = {(r.doc_id, r.fingerprint) for r in got}
    texts = [simhash.fingerprint((t or "").encode()) for _, t, _ in rows]
    assert sorted(fps) == sorted({(i, f"{f:016x}") for (i, _, _), f in zip(rows, texts, strict=True)})
    n = len(rows)
    root = components_of(n, [(i, j) for i in range(n) for j in range(i) if (texts[i] ^ texts[j]).bit_count() <= 4])
    least = {}
    for k, r in enumerate(root):
        least[r] = min(least.get(r, 10**9), rows[k][0])
    want = {(rows[k][0], f"{texts[k]:016x}"): least[root[k]] for k in range(n)}
    assert all(r.component_id == want[r.doc_id, r.fingerprint] for r in got)
    kept = simhash.dedup(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least[r] for r in set(root))
    assert simhash.near_duplicates(table(spark, []).limit(0)).count() == 0


def test_links_of_many_tasks_fill_few_files(spark, monkeypatch):
    files = {}
    files_by_label(monkeypatch, simhash, files)
    fps = np.random.default_rng(3).integers(0, 2**63, 400, dtype=np.int64)
    pairs = {(int(x), int(x) ^ 5) for x in fps}
    got = simhash.links(spark.createDataFrame([(x,) for p in pairs for x in p], "fp long")).distinct().collect()
    assert {(r.a, r.b) for r in got} == {(max(p), min(p)) for p in pairs}
    assert files["simhash-links"] == 1


def test_runs_too_long_to_compare_are_still_linked(spark, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", 8)
    monkeypatch.setattr(simhash, "SHORT", 4)
    rng = np.random.default_rng(2)
    fps = np.unique(np.concatenate([np.uint64(2**40 + 5) ^ np.array([1 << int(a) | 1 << int(b) for a, b in rng.integers(0, 64, (60, 2))], dtype=np.uint64), rng.integers(0, 2**64, 20, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    # in one process, so that the smaller limits hold there too
    import pyarrow as pa

    def batches(key, fp):
        order = np.argsort(key)
        for i in range(0, len(order), 37):
            some = order[i : i + 37]
            yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(fp[some].view(np.int64))], names=["k", "fp"])

    def compared(key, fp, refine):
        again = []
        for b in simhash._links_in_runs(batches(key, fp), refine):
            for x, y, k in zip(*[b.column(c).to_pylist() for c in "abk"], strict=True):
                (pairs.add((x, y)) if y is not None else far.add(x) if k is None else again.append((k, x)))
        return again

    pairs, far = set(), set()
    key, at = simhash.fuzzy_keys(fps)
    again = compared(key, fps[at], True)
    assert again
    refined = [(k, x) for b in simhash._refined(iter([pa.RecordBatch.from_arrays([pa.array([k for k, _ in again]), pa.array([x for _, x in again])], names=["k", "fp"])])) for k, x in zip(b.column("k").to_pylist(), b.column("fp").to_pylist(), strict=True)]
    assert not compared(np.array([k for k, _ in refined]), np.array([x for _, x in refined]).view(np.uint64), False)
    centres = defaultdict(list)
    for b in simhash._centres(iter([pa.RecordBatch.from_arrays([pa.array(sorted(far), type=pa.int64())], names=["fp"])])):
        for c, f in zip(b.column("centre").to_pylist(), b.column("fp").to_pylist(), strict=True):
            centres[c].append(f)
    pairs |= {(f, min(v)) for v in centres.values() for f in v}
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    n = len(fps)
    assert far
    assert components_of(n, [(place[a], place[b]) for a, b in pairs]) == components_of(n, [(i, j) for i in range(n) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 4])
    assert simhash.links(df).count() > 0


def test_a_third_segment_keeps_every_link_of_fuzzy_keys():
    """Pairs that only fuzzy keys find still share a key when all their runs are dealt anew."""
    import pyarrow as pa

    rng = np.random.default_rng(7)
    a = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        places = [0, 1, 2, 3] if i % 2 else rng.permutation([0, 0, 1, 2])
        for seg in places:
            b[i] ^= np.uint64(1 << int(16 * seg + rng.integers(0, 16)))
    owns, asks = defaultdict(set), defaultdict(set)
    for out, fps in ((owns, a), (asks, b)):
        key, at = simhash.fuzzy_keys(fps)
        fuzzy = key >> 33 >= 6
        for batch in simhash._refined(iter([pa.RecordBatch.from_arrays([pa.array(key[fuzzy]), pa.array(fps[at[fuzzy]].view(np.int64))], names=["k", "fp"])])):
            for k, x in zip(batch.column("k").to_pylist(), batch.column("fp").to_pylist(), strict=True):
                if out is asks or not k & 1:
                    out[x].add(k >> 1)
    signed_a, signed_b = a.view(np.int64).tolist(), b.view(np.int64).tolist()
    seg = lambda x, i: x >> np.uint64(16 * i) & np.uint64(0xFFFF)
    exact = np.sum([seg(a, i) == seg(b, i) for i in range(4)], axis=0)
    checked = [i for i in range(len(a)) if exact[i] < 2 and 0 < int(a[i] ^ b[i]).bit_count() <= 4]
    assert len(checked) > 1000 and all(owns[signed_a[i]] & asks[signed_b[i]] for i in checked)


def test_components(spark):
    rng = random.Random(6)
    pairs = [(i, i + 1) for i in range(0, 300)] + [(rng.randrange(400, 700), rng.randrange(400, 700)) for _ in range(150)] + [(1000, i) for i in range(1001, 1200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = components_of(1200, pairs)
    assert got == {x: root[x] for p in pairs if p[0] != p[1] for x in p}


# --- vectors


def vector_rows(spark, n=400, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((n // 8, dim))
    x = np.concatenate([c + s * rng.standard_normal((8, dim)) for c, s in zip(centre, rng.choice([0.05, 0.2, 0.4], len(centre)))]).astype(np.float32)
    x[50:60] = x[50]
    return x


@pytest.mark.parametrize("block", [1024, 20])
def test_vectors(spark, block):
    x = vector_rows(spark)
    rows = [(i, [float(v) for v in row], 1, 2) for i, row in enumerate(x)] + [(1000, None, 1, 2), (1001, [0.0] * 16, 1, 2), (1002, [float("nan")] * 16, 1, 2), (1003, [None] + [1.0] * 15, 1, 2), (1004, [], 1, 2), (1005, [1.0, 2.0], 1, 2), (1006, [2.0, 4.0], 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, key int")
    got = {r.vec_id: r for r in vectors.near_vectors(df, block=block).collect()}
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.95
    np.fill_diagonal(hit, False)
    root = components_of(len(x), list(zip(*[v.tolist() for v in np.nonzero(hit)], strict=True)))
    assert sum(got[i].n_links for i in range(len(x))) >= 0.97 * hit.sum()
    assert all(got[i].n_links <= hit[i].sum() for i in range(len(x)))
    assert np.mean([got[i].component_id == root[i] for i in range(len(x))]) > 0.97
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(x)))
    for i in range(1000, 1005):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[1006].n_links, got[1006].component_id) == (1, 1005)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_borderline_pairs_share_a_filter_at_every_size():
    for n in (20_000, 1 << 22, 5_000_000, 100_000_000):
        a, b = vectors.planted(64, 0.95, 400, np.random.default_rng(n))
        assert np.allclose((a * b).sum(axis=1), 0.95)
        codes, reach = vectors.choose(64, n)
        shared = np.any([vectors.sharing(code, a, b) for code in vectors.codes_of(64, n, codes, 0.95, reach, vectors.SEED)], axis=0)
        assert shared.mean() > 0.975, n


def test_vectors_of_many_lengths_and_repeated_ids(spark):
    """More lengths than any code is chosen for, equal vec_ids of different vectors, and null ids."""
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for dim in range(1, 91):
        x = rng.standard_normal(dim)
        rows += [(10 * dim, x.tolist()), (10 * dim + 1, (x * 2).tolist()), (10 * dim + 2, (-x).tolist())]
        want |= {10 * dim: (1, 10 * dim), 10 * dim + 1: (1, 10 * dim), 10 * dim + 2: (0, 10 * dim + 2)}
    one, two = [1.0] + [0.0] * 99, [0.0] * 99 + [1.0]
    rows += [(5, one), (5, two), (6, [3 * v for v in two]), (None, [-v for v in two])]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id in want:
            assert (r.n_links, r.component_id) == want[r.vec_id]
    assert Counter((r.n_links, r.component_id) for r in got if r.vec_id in (5, 6)) == Counter({(0, 5): 1, (1, 5): 2})


def test_vectors_that_share_a_hash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(vectors.F, "xxhash64", lambda *cols: vectors.F.lit(1).cast("long"))
    x = vector_rows(spark, 64, 8)[:40].astype(np.float64)
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.95
    np.fill_diagonal(hit, False)
    assert len(got) == 40 and hit.any()
    assert [got[i].n_links for i in range(40)] == hit.sum(axis=1).tolist()


def test_all_filters_agree_on_pairs_at_the_threshold():
    a, b = vectors.planted(64, 0.95, 4000, np.random.default_rng(5))
    one = vectors._decided(a, b, 0.95)
    assert 0.1 < one.mean() < 0.9  # rounding decides
    for size in (1, 3, 64, 500):
        for k in range(0, 1000, size):
            assert (np.diag(vectors._links(a[k : k + size], b[k : k + size], 0.95)) == one[k : k + size]).all()
            assert (np.diag(vectors._links(b[k : k + size], a[k : k + size], 0.95)) == one[k : k + size]).all()


# --- licences and secrets


def test_license_base_places(spark):
    rows = odd_rows(7, 150) + [(5000, "Licensed under CC-BY. CC BY all rights reserved; GNU General Public License, version 3.", "a")]
    got = {r.doc_id: r for r in licenses.scan(table(spark, rows)).collect()}
    for i, t, _ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert "gpl-3.0" in got[5000].labels and got[5000].score == 1.0
    assert licenses.scan(table(spark, []).limit(0)).count() == 0


def test_license_templates_survive_small_edits(spark):
    text = "permission is hereby granted free of charge to any person obtaining a copy of this program and associated documentation files"
    rows = [(1, f"x y {text} z", "a"), (2, "free of charge obtaining a copy", "a"), (3, "the version of the software", "a")]
    got = {r.doc_id: r for r in licenses.scan(table(spark, rows)).collect()}
    assert got[1].labels == "mit" and 0.6 <= got[1].score < 1 and got[1].matches == "mit:2"
    assert got[2].labels == got[3].labels == ""


def test_license_templates_against_every_place():
    """Notices planted whole, edited, cut and twice in other words: the index finds what a comparison at every place finds."""
    rng = random.Random(11)
    templates = licenses.templates_of(licenses.DEFAULT)
    vocabulary = sorted({w for t in templates for w in t.words})
    df = {w: rng.randrange(1, 900) for w in vocabulary}
    idf = {w: math.log(1001 / (n + 1)) + 1 for w, n in df.items()}
    index, found = licenses.Index(idf, templates), 0
    for n in range(150):
        text = [f"w{rng.randrange(500)}".encode() if rng.random() < 0.8 else rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        for t in rng.sample(templates, rng.randrange(0, 3)):
            own = list(t.words)
            for _ in range(rng.choice([0, 0, 2, len(own) // 6])):
                own[rng.randrange(len(own))] = b"changed"
            if n % 5 == 0:
                own = own[: len(own) * 3 // 4]
            at = rng.randrange(len(text) + 1)
            text[at:at] = own
        want = set()
        for t in templates:
            weight = sum(idf[w] for w in t.words)
            for place in range(-len(t.words), len(text)):
                if all(place + i >= 0 and tuple(text[place + i : place + i + len(p)]) == p for i, p in t.mandatory):
                    share = sum(idf[w] for i, w in enumerate(t.words) if 0 <= place + i < len(text) and text[place + i] == w) / weight
                    if share >= 0.6 and (not t.base or place >= 0):
                        want.add((t.label, t.words, place))
        assert {(t.label, t.words, place) for t, place, _ in index.find(text)} == want
        found += len(want)
    assert found > 100


def test_license_tags_and_own_templates(spark):
    mit = next(text for label, text, _ in licenses.TEXTS if label == "mit")
    rows = [(1, "// SPDX-License-Identifier: BSD-3-Clause", "a"), (2, f"Copyright (c) 2020 X. {mit.capitalize()}.", "a"), (3, "Ask the river council first, please.", "a")]
    got = {r.doc_id: r for r in licenses.scan(table(spark, rows)).collect()}
    assert got[1].labels == "bsd-3-clause" and "mit" in got[2].labels.split(",") and got[3].labels == ""
    own = {r.doc_id: r.labels for r in licenses.scan(table(spark, rows), [("council", "ask the river council first", ("river council",))]).collect()}
    assert own == {1: "", 2: "", 3: "council"}


def test_secret_base_spans(spark):
    key = "AKIA" + "B" * 16
    rows = odd_rows(8, 100) + [
        (5000, f"é token = \"{'a1' * 20}\" {key} AKIA12 {'f' * 24} {'f' * 23}", "a"),
        (5001, "PassWord:abc password='abcdef' api_key := x apikey=\"abcdefg\" ſecret=abcdefgh", "a"),
    ]
    got = {r.doc_id: r for r in secrets.scan(table(spark, rows)).collect()}
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
    for i, t, _ in rows:
        t = t or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        listed = ",".join(f"{k}:{a}:{z}" for a, _, z, k in sorted(spans))
        r, n = got[i], Counter(s[3] for s in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"])
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(filter(None, r.spans.split(",")))


def test_weak_secrets_need_their_complement():
    key, user, url = "Zq3+xT9/Lm2Vb7Kd0pRs", "user = bob12", "https://db.example.com/x"

    def kinds(text):
        base = secrets.base_spans(text)
        return {k for _, _, k in secrets.linked(text, base, secrets.weak_spans(text, base))}

    assert kinds(f"{user}") == kinds(f"{key}") == kinds(f"{url}") == set()
    assert kinds(f"{user}\n{key}") == {"id", "key"}
    assert kinds(f"{url} {key}") == {"key"}
    assert kinds(f"{user} {url} {key}") == {"id", "key", "url"}
    assert kinds(f"{user}\n\n{key}") == kinds(f"{user} {'x ' * 400}{key}") == set()
    assert kinds(f"{user} password=hunter22") == {"id"}


def test_linking_against_all_pairs():
    """Texts of parts, noise and blank lines: each weak finding with each other one and each base one, by distance and scope."""
    rng = random.Random(12)
    parts = ["Zq3+xT9/Lm2Vb7Kd0pRs", "user = bob12", "login: x_y_z", "https://db.example.com/x?token=abcdef123", "ssh://h/q", "AKIA" + "B" * 16, "AKIAB1234", "password=hunter22", "f0" * 14, "\n\n", "\n \t\n", "\n"]
    kinds = {"id": ("access", "id"), "key": ("assign", "hex", "key"), "url": ("url",)}
    reported = 0
    for _ in range(400):
        text = " ".join(rng.choice(parts) if rng.random() < 0.4 else "x" * rng.randrange(1, 60) for _ in range(rng.randrange(1, 25)))
        base = secrets.base_spans(text)
        weak = secrets.weak_spans(text, base)
        cuts = [(m.start(), m.end()) for m in re.finditer(r"\n[ \t\r]*\n", text)]
        want = []
        for s, e, k in weak:
            lo = max([s - 300, 0, *[z for _, z in cuts if z <= s]])
            hi = min([e + 300, len(text), *[a for a, _ in cuts if a >= e]])
            has = {part: any(x[2] in own and x[0] < hi and x[1] > lo for x in base + weak) for part, own in kinds.items()}
            if {"id": has["key"], "key": has["id"] or has["url"], "url": has["id"] and has["key"]}[k]:
                want.append((s, e, k))
        assert sorted(secrets.linked(text, base, weak)) == sorted(want)
        assert all(not any(b[0] <= s and e <= b[1] for b in base) for s, e, _ in weak)
        reported += len(want)
    assert reported > 300


def test_an_endpoint_that_overlaps_a_finding_is_still_a_part():
    text = "https://host/x?token=abcdef123 Zq3+xT9/Lm2Vb7Kd0pRs"
    base = secrets.base_spans(text)
    assert [k for _, _, k in base] == ["assign"]
    assert "key" in {k for _, _, k in secrets.linked(text, base, secrets.weak_spans(text, base))}


# --- quality and toxicity


def labelled(spark, n=1500, seed=0):
    rng = random.Random(seed)
    good = [f"{a}{b}" for a in ("ri", "sto", "ne", "lo", "ma") for b in ("ver", "lan", "dor", "tis")]
    docs, marks = [], []
    for i in range(n):
        words = rng.choices(good, k=rng.randrange(15, 60))
        bad, toxic = rng.random() < 0.2, rng.random() < 0.2
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiotic", "moronic"]))
        text = " ".join(f"{w.upper()}!!" if bad else w for w in words)
        docs.append((i, text, "s"))
        if i % 2:
            marks.append((i, int(not bad), int(toxic), "x"))
    docs += [(n + 1, None, "s"), (n + 2, "", "s"), (n + 3, "word " * 50_000, "s"), (None, "no id", "s"), (3, "twice", "s")]
    marks += [(5, None, None, "x"), (7, marks[3][1], marks[3][2], "x"), (None, 1, 1, "x")]
    return docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int, fold string"), {m[0]: m for m in marks[: n // 2]}


def test_quality(spark):
    docs, marks, truth = labelled(spark)
    got = quality.score(table(spark, docs), marks).collect()
    assert len(got) == len(docs)
    test = [(r.predicted, truth[r.doc_id][1]) for r in got if r.held_out and r.doc_id in truth and r.doc_id != 3]
    assert len(test) > 50 and np.mean([a == b for a, b in test]) > 0.97
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0)
    kept = quality.keep_good(table(spark, docs), marks)
    assert kept.columns == table(spark, docs).columns and 0.7 * len(docs) < kept.count() < 0.9 * len(docs)


def test_toxicity(spark):
    docs, marks, truth = labelled(spark)
    got = toxicity.score(table(spark, docs), marks).collect()
    assert len(got) == len(docs)
    test = [(r.predicted, truth[r.doc_id][2]) for r in got if r.held_out and r.doc_id in truth and r.doc_id != 3]
    assert np.mean([a == b for a, b in test]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_isotonic_is_the_best_non_decreasing_fit():
    rng = np.random.default_rng(9)
    for _ in range(60):
        total = rng.integers(0, 6, 40)
        right = rng.binomial(total, np.clip(np.linspace(0, 1, 40) + rng.normal(0, 0.3, 40), 0, 1))
        if not total.any():
            continue
        want = plain_isotonic(list(zip(right.tolist(), total.tolist(), strict=True)))
        got = np.maximum.accumulate(calibration.isotonic(right.astype(float), total.astype(float)))
        first = int(np.flatnonzero(total)[0])
        assert np.allclose(got[first:], want[first:])


def plain_quality(rows, known):
    """{doc_id: (raw, score)}: statistics by loops and regular expressions, one design matrix, ridge by least squares, isotonic by its formula."""
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in rows}

    def statistics(t):
        raw = t.encode()
        n = max(1, len(raw))
        sets = [set(range(65, 91)), set(range(97, 123)), set(range(48, 58)), {32}, {10}, {46}, {44}, set(b"!?"), set(b"|<>{}[]=;/\\"), set(b"*$%&#@~^_+"), set(range(128, 256))]
        counts = Counter(raw)
        shares = [sum(counts[b] for b in x) / n for x in sets]
        words, lines = re.findall(rb"[^\x20\x09-\x0D]+", raw), [x for x in raw.split(b"\n") if x]
        k = len(words)
        of_words = [math.log1p(k), sum(map(len, words)) / k, len(set(words)) / k, len(set(words)) / k**0.8, sum(a == b for a, b in zip(words, words[1:])) / k, len({tuple(words[i : i + 3]) for i in range(k - 2)}) / max(1, k - 2)] if k else [0.0] * 6
        of_lines = [math.log1p(len(lines)), len(set(lines)) / len(lines), math.log1p(len(raw) / len(lines)), max(map(len, lines)) / len(raw)] if lines else [0.0] * 4
        return [math.log1p(len(raw)), *shares, shares[0] / max(shares[0] + shares[1], 1e-9), *of_words, *of_lines]

    x = {i: statistics(t or "") for i, t in rows}
    fit = [i for i in x if i in known and fold[i] in (1, 2, 3)]
    a = np.array([x[i] for i in fit])
    mean, spread = a.mean(axis=0), a.std(axis=0)
    spread = np.where(spread > 1e-9, spread, 1)
    rng = np.random.default_rng(11)
    turn, phase = rng.standard_normal((a.shape[1], 192)) / (0.7 * math.sqrt(a.shape[1])), rng.uniform(0, 2 * np.pi, 192)
    design = lambda rows: np.column_stack([np.ones(len(rows)), math.sqrt(2 / 192) * np.cos(np.clip((np.array(rows) - mean) / spread, -6, 6) @ turn + phase)])
    z, y = design([x[i] for i in fit]), np.array([known[i] for i in fit], dtype=float)
    penalty = np.sqrt(np.concatenate([[1e-9], np.full(192, 1e-3 * len(fit) / 192)]))
    w = np.linalg.lstsq(np.vstack([z, np.diag(penalty)]), np.concatenate([y, np.zeros(193)]), rcond=None)[0]
    raw = {i: min(1.5, max(-0.5, v)) / 2 + 0.25 for i, v in zip(x, design(list(x.values())) @ w, strict=True)}
    return {i: (v, s) for (i, v), s in zip(raw.items(), plain_scores(raw, known, fold), strict=True)}


def plain_scores(raw, known, fold):
    bins = [[0, 0] for _ in range(500)]
    for i, v in raw.items():
        if i in known and fold[i] == 4:
            b = bins[min(499, int(v * 500))]
            b[0], b[1] = b[0] + known[i], b[1] + 1
    rates = plain_isotonic(bins)
    for v in raw.values():
        at = min(499, max(0, v * 500 - 0.5))
        low = int(at)
        yield rates[low] + (rates[min(499, low + 1)] - rates[low]) * (at - low)


def test_quality_equals_a_plain_version(spark):
    docs, marks, truth = labelled(spark, 300, 4)
    docs = [(i, t, s) for i, t, s in docs if i is not None and i != 3 and len(t or "") < 5000] + [(8000, "Line one.\nLine one.\n\n été 12 | {x}", "s")]
    known = {i: m[1] for i, m in truth.items() if i not in (3, 5, 7)}
    want = plain_quality([(i, t) for i, t, _ in docs], known)
    got = {r.doc_id: r for r in quality.score(table(spark, docs), spark.createDataFrame(list(known.items()), "doc_id long, quality int")).collect()}
    assert got.keys() == want.keys()
    assert all(got[i].raw == pytest.approx(want[i][0], abs=1e-4) for i in want)
    raw = {i: r.raw for i, r in got.items()}
    for i, score in zip(raw, plain_scores(raw, known, {i: zlib.crc32(str(i).encode()) % 5 for i in raw}), strict=True):
        assert got[i].score == pytest.approx(score, abs=1e-9)


def test_sums_by_tree_are_the_sums(spark):
    rows = spark.range(1000).repartition(41)
    got = quality.total(rows, (2,), lambda b: np.array([b.num_rows, sum(b.column("id").to_pylist())], dtype=float), fan=4)
    assert got.tolist() == [1000, 499_500]


def test_scores_without_labels_or_rows(spark):
    docs, marks, _ = labelled(spark, 40)
    for f in (quality.score, toxicity.score):
        assert {r.score for r in f(table(spark, docs), marks.limit(0)).collect()} == {0.5}
        assert f(table(spark, []).limit(0), marks).count() == 0


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(3)
    examples = []
    for i in range(900):
        terms = sorted(rng.choice(12, rng.integers(0, 5), replace=False).tolist())
        examples.append((i, terms, rng.integers(1, 6, len(terms)).astype(float).tolist(), float(rng.random() < 0.3)))
    idf = rng.uniform(1, 5, 12)
    index = toxicity.Index.of(examples, idf, 0.1)
    dense = np.zeros((len(index.ids), 12))
    known = {e[0]: e for e in examples}
    for n, i in enumerate(index.ids.tolist()):
        dense[n, known[i][1]] = index.vector(known[i][1], known[i][2])
    for _ in range(200):
        terms = sorted(rng.choice(12, rng.integers(1, 5), replace=False).tolist())
        tfs = rng.integers(1, 6, len(terms)).astype(float).tolist()
        q = np.zeros(12)
        q[terms] = index.vector(terms, tfs)
        cos = dense @ q
        kth = np.sort(cos)[::-1][toxicity.NEIGHBOURS - 1]
        want = set(np.flatnonzero((cos >= kth - 1e-9) & (cos > 0)).tolist())
        at, _ = index.nearest(terms, tfs)
        assert set(at.tolist()) == want


def test_toxicity_of_few_examples_and_rare_terms(spark):
    """Fifty examples, and toxic texts of which each word is in few: no term is left out."""
    rng = random.Random(5)
    docs, marks, kind = [], [], {}
    for i in range(120):
        words = [f"w{rng.randrange(300)}" for _ in range(25)]
        kind[i] = i % 4 == 0
        if kind[i]:
            words += [f"réeux{rng.choice('abcdefghijkl')}{rng.randrange(50)}" for _ in range(4)]
        docs.append((i, " ".join(words), "s"))
        if i < 80:
            marks.append((i, int(kind[i])))
    got = toxicity.score(table(spark, docs), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
    raw = {r.doc_id: r.vote for r in got if r.doc_id >= 80}
    toxic, clean = [raw[i] for i in raw if kind[i]], [raw[i] for i in raw if not kind[i]]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.9
    assert all(r.evidence for r in got)


def plain_toxicity(rows, marks):
    """{doc_id: (vote, score)} from raw texts, with dictionaries: every cosine with every example."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t)) if w]
    terms = {i: Counter(x for w in cut(t or "") for x in ([w, w[:5] + "-"] if len(w) > 5 else [w])) for i, t in rows}
    examples = [i for i, _ in rows if i in marks and fold(i) in (1, 2, 3)]
    toxic = [i for i in examples if marks[i]]
    known = set().union(*(terms[i] for i in examples))
    weight = {}
    for x in known:
        df = sum(x in c for c in terms.values())
        a, b = sum(x in terms[i] for i in toxic) + 0.5, sum(x in terms[i] for i in examples if not marks[i]) + 0.5
        c, d = len(toxic) + 1 - a, len(examples) - len(toxic) + 1 - b
        z = max(0, math.log(a * d / (b * c))) / math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
        weight[x] = (math.log((len(rows) + 1) / (df + 1)) + 1) * (0.1 + 0.9 * z * z / (z * z + 20))
    other = (math.log((len(rows) + 1) / 2) + 1) * 0.1
    vector = {i: {x: n * weight.get(x, other) for x, n in c.items()} for i, c in terms.items()}
    length = {i: math.sqrt(sum(v * v for v in c.values())) or 1 for i, c in vector.items()}
    vote = {}
    for i in terms:
        cos = sorted(((sum(v * vector[e].get(x, 0) for x, v in vector[i].items() if x in known) / length[i] / length[e], e) for e in examples), reverse=True)
        cos = [(c, e) for c, e in cos if c > 1e-12 and c >= cos[min(15, len(cos)) - 1][0] - 1e-9]
        near = [(1 / (1 - min(1, c) + 0.02), marks[e]) for c, e in cos]
        vote[i] = sum(w * m for w, m in near) / sum(w for w, _ in near) if near else (len(toxic) + 0.5) / (len(examples) + 1)
    bins = [[0, 0] for _ in range(500)]
    for i in vote:
        if i in marks and fold(i) == 4:
            b = bins[min(499, int(vote[i] * 500))]
            b[0], b[1] = b[0] + marks[i], b[1] + 1
    rates = plain_isotonic(bins)
    score = {}
    for i, v in vote.items():
        at = min(499, max(0, v * 500 - 0.5))
        low = int(at)
        score[i] = rates[low] + (rates[min(499, low + 1)] - rates[low]) * (at - low)
    return {i: (vote[i], score[i]) for i in vote}


def plain_isotonic(bins):
    """Smoothed rates of the isotonic fit by its min-max formula over filled bins; empty bins take the one before (the first ones the first)."""
    filled = [(k, r, t) for k, (r, t) in enumerate(bins) if t]
    fit = {}
    for n, (k, _, _) in enumerate(filled):
        fit[k] = max(min(sum(r for _, r, _ in filled[i : j + 1]) / sum(t for _, _, t in filled[i : j + 1]) for j in range(n, len(filled))) for i in range(n + 1))
    level = {}
    for k, r, t in filled:
        a = level.setdefault(round(fit[k], 12), [0, 0])
        a[0], a[1] = a[0] + r, a[1] + t
    rate = {k: (level[round(fit[k], 12)][0] + 0.5) / (level[round(fit[k], 12)][1] + 1) for k in fit}
    out, last = [], rate[min(rate)]
    for k in range(len(bins)):
        last = rate.get(k, last)
        out.append(max([last, *out[-1:]]))
    return out


def test_toxicity_equals_a_plain_version(spark):
    docs, marks, truth = labelled(spark, 400, 3)
    docs = [(i, t, s) for i, t, s in docs if i is not None and i != 3 and len(t or "") < 10_000] + [(9000, "É" * 8 + " élan étoffée", "s"), (9001, "zzz yyy", "s")]
    known = {i: m[2] for i, m in truth.items() if i not in (3, 5, 7)}
    got = toxicity.score(table(spark, docs), spark.createDataFrame(list(known.items()), "doc_id long, toxic int")).collect()
    want = plain_toxicity([(i, t) for i, t, _ in docs], known)
    assert len(got) == len(docs)
    for r in got:
        assert (r.vote, r.score) == pytest.approx(want[r.doc_id], abs=1e-9)


def test_bounds_leave_blocks_closed_and_neighbours_exact():
    """Many blocks: some are never opened, and the nearest are those that a full comparison finds."""
    rng = np.random.default_rng(8)
    examples = []
    for i in range(1200):
        topic = 40 * (i % 6)
        terms = np.unique(np.concatenate([topic + rng.integers(0, 40, 12), rng.integers(240, 900, 6)]))
        examples.append((i, terms.tolist(), rng.integers(1, 4, len(terms)).astype(float).tolist(), float(i % 5 == 0)))
    idf = rng.uniform(0.5, 3, 900)
    index = toxicity.Index.of(examples, idf, 0.1, block=16)
    dense = np.zeros((1200, 900))
    for e in examples:
        dense[e[0], e[1]] = index.vector(e[1], e[2])
    queries = [(np.array(e[1]), index.vector(e[1], e[2])) for e in examples[:200]]
    cos = index.cosines(queries)
    assert (cos < 0).mean() > 0.3
    full = dense[:200] @ dense.T
    for row, own in zip(full, cos, strict=True):
        want = set(np.flatnonzero(row >= np.sort(row)[-toxicity.NEIGHBOURS] - 1e-9).tolist())
        assert set(index.ids[index.best(own, toxicity.NEIGHBOURS)[0]].tolist()) == want
