"""The pipeline against a plain version of itself on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from blockcat.llm import simhash
from test_text_operators import plain_quality


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def plain(spark, sf_dir):
    """(doc_id, text) of what is packed, repeats included."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality is not None}
    scores = plain_quality([(r.doc_id, r.text) for r in docs.collect()], marks)
    good = {i for i, (_, score) in scores.items() if score >= 0.3}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in good}
    last = {}
    for i in sorted(rows):
        last[rows[i].text] = i
    ids = sorted(last.values())
    prints = [simhash.fingerprint(rows[i].text.encode()) for i in ids]
    root = list(range(len(ids)))
    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4 and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if x == old else x for x in root]
    ids = [i for k, i in enumerate(ids) if root[k] == k]
    size = {i: len(words(rows[i].text)) for i in ids}
    whole = Counter()
    for i in ids:
        whole[rows[i].source] += size[i]
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sorted(whole))}
    target, free, left = {}, set(whole), 1.5 * sum(whole.values())
    while True:
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) >= 2 * whole[s]}
        if not over:
            break
        target |= {s: 2 * whole[s] for s in over}
        free -= over
        left -= sum(2 * whole[s] for s in over)
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    out = []
    for s in whole:
        budget = round(target[s])
        epochs, rest = divmod(budget, whole[s])
        for i in sorted((i for i in ids if rows[i].source == s), key=lambda i: (hashlib.md5(f"mix:{i}".encode()).hexdigest()[:16], i)):
            out += [(i, rows[i].text)] * epochs
            n = min(size[i], rest)
            rest -= n
            if n == size[i]:
                out.append((i, rows[i].text))
            elif n:
                ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", rows[i].text)]
                out.append((i, rows[i].text[: ends[n - 1]]))
    return out


def test_pipeline_equals_the_plain_version(spark, sf_dir):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    total = 0
    for i, text in plain(spark, sf_dir):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        total += len(ids)
        for k in range(0, len(ids), 4096):
            want[i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += 1
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 4096
    assert len(bins) <= -(-total // 4096) + 1


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(30), sf_dir).columns == docs.columns, name


ODD = "doc_id long, text string, lang string, source string, n_chars long, _id int, size string, _own int, part map<string,int>"


def odd_tables(spark, folder, rows):
    """Documents with columns named like the pipeline's own, and labels by which prose of small words is good."""
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "x", 2, {"a": 1}) for i, t, s in rows], ODD)
    docs.write.parquet(f"{folder}/documents.parquet")
    marks = [(i, int(not (t or "").isupper()), 0) for i, t, _ in rows if i is not None]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in any column, empty, long, equal, near and repeated texts, ties, and clashing columns."""
    prose = [" ".join(f"word{(7 * i + j * (i % 11 + 1)) % 97}" for j in range(30 + i % 7)) for i in range(60)]
    rows = [(i, t if i % 3 else f"{t.upper()} !!! ???".upper(), "abc"[i % 3] if i % 10 else None) for i, t in enumerate(prose)]
    rows += [(100, None, "a"), (101, "", "a"), (102, " \n\t", None), (None, prose[1] + " more of it", "a"), (None, prose[2], "b")]
    rows += [(200 + i, prose[4], "a") for i in range(12)] + [(300, prose[5], "c"), (300, prose[5], "c"), (300, prose[7], "c")]
    rows += [(400, " ".join(f"long{i % 5003}" for i in range(60_000)), "b")]
    docs = odd_tables(spark, tmp_path, rows)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        assert kept.columns == docs.columns, name
    again = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in again)
    ids = {r.doc_id for r in got}
    assert not any(200 <= (i or 0) < 211 for i in ids) and 4 not in ids and 400 in ids
    assert not ids & {100, 101, 102} and not ids & set(range(0, 60, 3))
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 4096


def test_pipeline_of_nothing(spark, tmp_path):
    odd_tables(spark, tmp_path / "x", [(1, "a", "b")])
    spark.read.parquet(f"{tmp_path}/x/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/x/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
