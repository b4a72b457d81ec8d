"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeats and empty tables."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.llm import bpe, fingerprints, hnsw, jaccard_join, licenses, line_dedup, mixing, personal_data, secrets, toxicity
from meterlake.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, a string, node string"


def make(spark, texts, sources=None, ids=None):
    rows = [(ids[i] if ids else i, t, "en", (sources or ["s"])[i % len(sources or ["s"])], len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [words(rng, rng.randrange(3, 220)) for _ in range(60)]
    out = [" ".join(b) for b in base]
    for b in base[:25]:
        for _ in range(rng.randrange(1, 6)):
            c = list(b)
            for _ in range(rng.randrange(0, 4)):
                c[rng.randrange(len(c))] = "edit" + str(rng.randrange(9))
            out.append((" ".join(c)).upper() if rng.random() < 0.3 else "\n".join(c))
    return [*out, None, "", " \t\n", "one two", "One  two", "é 中文 \U0001f600", " ".join(words(rng, 20_000)), out[0], out[0]]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j]:
                k = len(sets[i] & sets[j])
                if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_jaccard_join(spark, texts):
    docs = make(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(docs).collect()}
    sets = [shingles(t) for t in texts]
    assert got == {i: (len(sets[i]), c) for i, c in enumerate(components(sets))}
    kept = [r.doc_id for r in jaccard_join.keep_one_of_each(docs).collect()]
    assert sorted(kept) == sorted(set(components(sets)))
    assert jaccard_join.similar_documents(docs.limit(0)).count() == 0


def test_family_slices_find_all_links(spark, monkeypatch):
    """A chain of small edits: neighbours link, distant members don't; families take several slices."""
    w = words(random.Random(1), 60)
    chain = [" ".join(w)]
    for i in range(40):
        w[i % 60] = f"step{i}"
        chain.append(" ".join(w))
    random.Random(2).shuffle(chain)
    monkeypatch.setattr(jaccard_join, "SLICE", 5)
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_documents(make(spark, chain)).collect()}
    assert got == dict(enumerate(components([shingles(t) for t in chain])))


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (5, 4), (4, 5), (7, 7), (9, 3), (None, 1), (1, 2)], "a long, b long")
    assert {(r.node, r.component) for r in connected_components(e).collect()} == {(1, 1), (2, 1), (3, 1), (9, 1), (4, 4), (5, 4)}
    path = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    assert connected_components(path).select("component").distinct().collect()[0][0] == 0
    assert connected_components(e.limit(0)).count() == 0


def test_components_with_hubs(spark):
    """Stars of hundreds of leaves, of which some share leaves or hang on chains, against union-find."""
    r = random.Random(4)
    edges = [(hub, r.randrange(10_000, 14_000)) for hub in (3, 20_000, 12_345) for _ in range(400)]
    edges += [(30_000 + k, 30_001 + k) for k in range(40)] + [(50_000, r.randrange(50_001, 60_000)) for _ in range(500)] + [(50_000, 30_040)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    e = spark.createDataFrame([x if r.random() < 0.5 else x[::-1] for x in edges], "a long, b long")
    assert {x.node: x.component for x in connected_components(e).collect()} == {x: find(x) for x in list(parent)}


def test_mixing(spark, texts):
    sources = ["a", "b", None, "c", "b", "b"]
    docs = make(spark, texts, sources)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts) and sum(r.size for r in rows) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.copies <= 2
        by.setdefault(sources[r.doc_id % 6], []).append(r)
    total, sizes = sum(r.size for r in rows), {s: sum(r.size for r in g) for s, g in by.items()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:  # the excess is reshared until none is above
        left = 1.5 * total - sum(2 * sizes[s] for s in full)
        rest = sum(weight[s] for s in order if s not in full)
        target = {s: 2 * sizes[s] if s in full else left * weight[s] / rest for s in order}
        more = {s for s in order if s not in full and target[s] > 2 * sizes[s]}
        if not more:
            break
        full |= more
    for s, g in by.items():
        assert g[0].source_size == sizes[s] and abs(g[0].target - target[s]) < 1e-6
        assert abs(sum(r.taken for r in g) - target[s]) <= 0.5 + 1e-6
    assert mixing.mix(docs.limit(0)).count() == 0
    assert sum(r.taken for r in mixing.mix(make(spark, [None, ""])).collect()) == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)


def test_line_dedup(spark):
    rng = random.Random(3)
    note = "This page was printed on {} by the archive office"
    docs = [f"{' '.join(words(rng, 12))}\n{note.format(i)}\nshort line\n{' '.join(words(rng, 9))}" for i in range(12)] + [None, "", "plain"]
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(make(spark, docs)).collect()}
    assert got[0].n_dropped == 0 and got[0].text == docs[0]
    for i in range(1, 12):
        lines = docs[i].split("\n")
        assert got[i].text == "\n".join([lines[0], *lines[2:]]) and got[i].n_dropped == 1
    assert (got[12].text, got[12].n_lines, got[13].text, got[14].text) == (None, 0, "", "plain")
    assert line_dedup.drop_recurring_lines(make(spark, docs).limit(0)).count() == 0


def test_exact_lines_and_passages(spark):
    """Short lines and rows of numbers that recur word by word go, and passages from two documents on."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(6)
    passage, brief = " ".join(words(rng, 51)), " ".join(words(rng, 50))
    docs = [f"Les.\n\n {' '.join(words(rng, 9))}\n1 2 3\nrow {i}\n{' '.join(words(rng, 120))}" + (f"\n{passage}\n{brief}" if i in (3, 7) else "") for i in range(12)]
    cut = {r.doc_id: r for r in pipeline.drop_recurring_lines(spark, make(spark, docs), "").collect()}
    for i, t in enumerate(docs):
        lines = t.split("\n")
        assert cut[i].text == (t if i == 0 else "\n".join([*lines[1:3], *lines[4:]])) and cut[i].n_chars == len(cut[i].text)
    kept = {r.doc_id: r for r in pipeline.keep_one_of_near_copies(spark, make(spark, [*docs, docs[3]]), "").collect()}
    assert {i: r.text for i, r in kept.items()} == {i: t if i != 7 else t.replace(f"\n{passage}", "") for i, t in enumerate(docs)}
    assert kept[7].n_chars == len(kept[7].text)


def test_byte_bpe(spark, texts):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.vocabulary(), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    letters = " \t\n\r'stmdrevlabcé1²½!,.-  \x1c中\U0001f600'　S  ́ñ"
    many = [*texts, *("".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(3000))]
    out = bpe.encode_documents(make(spark, many), bpe.vocabulary(), with_ids=True)
    for r in out.collect():
        t = many[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert r.ids == ids and r.n_tokens == len(ids) == len(r.offsets)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode_ids(out.limit(50), bpe.vocabulary()).collect()}
    assert all(back[i] == (many[i] or "") for i in back) and len(back) == 50
    assert bpe.encode_documents(make(spark, texts).limit(0), bpe.vocabulary()).count() == 0


def test_toxicity(spark):
    rng = random.Random(4)
    bad = ["gruff", "vile", "zorkel"]
    texts, toxic = [], []
    for i in range(400):
        w = words(rng, rng.randrange(5, 60))
        toxic.append(int(i % 4 == 0))
        if toxic[-1]:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad) + ("" if rng.random() < 0.5 else "ish"))
        texts.append(" ".join(w))
    texts += [None, "", "x " * 30_000]
    docs = make(spark, texts)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.score_documents(docs, toxicity.fit(docs, labels)).collect()}
    held = [i for i in range(400) if rows[i].held_out]
    assert 40 < len(held) < 120 and len(rows) == len(texts)
    assert np.mean([rows[i].predicted == toxic[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows.values()) and rows[400].score == rows[401].score < 0.5
    hit = next(i for i in held if toxic[i] and rows[i].predicted)
    assert any(texts[hit][s.start : s.end].startswith(tuple(bad)) for s in rows[hit].spans)
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_documents(docs, none).collect()} == {0.0}
    assert toxicity.drop_toxic(docs, none).columns == docs.columns and toxicity.drop_toxic(docs, none).count() == len(texts)


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    e, trans = rng.normal(size=7), rng.normal(size=(2, 2))
    first = np.array([1, 0, 0, 0, 1, 0, 0], bool)
    p, _ = toxicity.marginals(e, first, trans)
    want, z = np.zeros(7), 0.0
    for code in range(128):
        y = [(code >> k) & 1 for k in range(7)]
        s = sum(e[k] * y[k] for k in range(7)) + sum(trans[y[k - 1], y[k]] for k in range(7) if not first[k])
        want += np.exp(s) * np.array(y)
        z += np.exp(s)
    assert np.allclose(p, want / z)


def test_secrets_and_personal_data(spark):
    t = ['x Password: "abcdefgh1" y', "token=short", "AKIAABCDEFGHIJKL12 " + "0123456789abcdef" * 3, "é api_key = Zz9/+_.=-aaaa", None, "", "a" * 5000 + " paſſword=abcdefgh1"]
    r = secrets.scan_documents(make(spark, t), secrets.fit(make(spark, t))).orderBy("doc_id").collect()
    assert [(x.n_assign, x.n_access, x.n_hex) for x in r] == [(1, 0, 0), (0, 0, 0), (0, 1, 1), (1, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 1)]
    assert r[0].spans == "assign:2:22" and r[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    t = ["mail jo.e+1@ex-a.co.uk, 10.0.0.255 and 1.2.3.256", "4111 1111 1111 1111 or 4111 1111 1111 1112", "call +1 (234) 555-6789!", None, "", "@" * 2000, "a@b", "1" * 50]
    docs = make(spark, t)
    r = personal_data.scan_documents(docs, personal_data.fit(docs)).orderBy("doc_id").collect()
    assert [(x.n_email, x.n_ip, x.n_card, x.n_phone) for x in r] == [(1, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), *[(0, 0, 0, 0)] * 5]
    assert "email:5:22" in r[0].spans and "ip:24:34" in r[0].spans
    one = make(spark, ["4111 1111 1111 1111."])
    assert personal_data.scan_documents(one, personal_data.fit(one)).first().n_card == 1
    assert personal_data.scan_documents(docs.limit(0), personal_data.fit(docs.limit(0))).count() == 0


def test_licenses(spark):
    t = ["Under the MIT License, or the Apache License; CC-BY 4", None, "", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH X", "mité license", "Mit license mit LICENSE"]
    r = licenses.scan_documents(make(spark, t)).orderBy("doc_id").collect()
    assert (r[0].n_words, r[0].n_base, r[0].first_word, r[0].last_word, r[0].base_labels) == (11, 3, 2, 8, "apache,cc-by,mit")
    assert r[1].n_words == r[2].n_words == 0 and r[1].first_word is None and r[2].labels == ""
    assert r[3].labels == "apache,gpl,mit" and r[4].n_base == 0 and (r[5].first_word, r[5].last_word, r[5].n_base) == (0, 2, 2)
    assert licenses.parse("A OR B AND C") == ["A", "B", "C", "and", "or"] and licenses.parse("(A") == []


def test_hnsw(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1200, 16))
    x[100:160] = x[100]
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [None] * 16), (5080, [])]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>")
    rows = hnsw.nearest(df, "vec_id % 20 = 0", 20, shard=500).collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = 0
    for q in range(0, 1200, 20):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(1200), -s)) if i != q][:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and all(abs(m[2] - s[m[1]]) < 1e-9 for m in mine)
        hit += len({m[1] for m in mine} & set(order))
    assert hit / (60 * 20) >= 0.95 and set(got) == set(range(0, 1200, 20))
    few = hnsw.nearest(df.where("vec_id < 3"), "vec_id % 20 = 0", 20).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert hnsw.nearest(df.limit(0), "vec_id % 20 = 0").count() == 0


def test_fingerprints(spark, texts):
    docs = make(spark, texts)
    rows = {r.doc_id: r for r in fingerprints.fingerprints(docs, rows_per_bucket=10).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, after = t or "", texts[i - 1] or ""  # descending ids; after the last, the first
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[i].n_chars == len(t)
        assert rows[i].fingerprint == str(fingerprints.Fingerprint.of(t)) == str(fingerprints.Fingerprint.parse(rows[i].fingerprint))
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    assert fingerprints.fingerprints(make(spark, ["alone"])).first().near_next == 1.0
    assert fingerprints.fingerprints(docs.limit(0)).count() == 0
    a, b = fingerprints.Fingerprint.of("one.\ntwo.\nthree."), fingerprints.Fingerprint.of("one.\nTWO.\nthree.")
    assert [p for _, p in a.differing(b)] and 0 < a.likeness(b) < 1


def test_likeness_follows_the_share_kept():
    """One sentence, one repeated word, no blanks, other full stops: two thirds are kept."""
    rng = random.Random(8)
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9000)) + ("。" if i % 20 == 19 else "") for i in range(600))
    cases = [" ".join(words(rng, 40)), "word " * 655, "".join(rng.choice("abcdefgh") for _ in range(3000)), cjk, "x" * 500, "\n".join(["", cjk[:90], " ", cjk[90:200]])]
    for t in cases:
        k = len(t) // 3
        edited = t[: len(t) - k] + "".join(rng.choice("stuvwxyz") for _ in range(k))
        a, b = fingerprints.Fingerprint.of(t), fingerprints.Fingerprint.of(edited)
        assert abs(a.likeness(b) - 2 / 3) < 0.12 and a.likeness(fingerprints.Fingerprint.of(edited[-k:])) < 0.05
        assert [[n for _, n in p] for s in a.sections for _, p in s[1]] and all(n <= fingerprints.MOST for s in a.sections for _, p in s[1] for _, n in p)
        assert [sum(n for _, n in p) for s in a.sections for _, p in s[1]] == [len(line) for line in t.split("\n")]


def test_null_and_repeated_ids(spark, tmp_path):
    """Rows without a doc_id, or that repeat one, are documents of their own if their texts differ, in all stages."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    t = [" ".join(words(rng, 60, 5000)) for _ in range(6)]
    note = "printed by the archive office of the town\n"
    texts = [t[0], t[1], t[2], t[2], t[3], t[4], t[4], "", " ", None, *(note + " ".join(words(rng, 60, 5000)) for _ in range(12))]
    ids = [None, None, None, 7, 8, 8, 8, None, None, 9, *([None] * 12)]
    docs = make(spark, texts, ids=ids)
    kept = sorted((r.doc_id or 0, r.text or "") for r in jaccard_join.keep_one_of_each(docs).collect())
    assert kept == sorted([(0, t[0]), (0, t[1]), (7, t[2]), (8, t[3]), (8, t[4]), (0, ""), (0, " "), (9, ""), *((0, x) for x in texts[10:])])
    cut = [r.text for r in line_dedup.drop_recurring_lines(docs).collect()]
    assert sum(note in (x or "") for x in cut) == 1 and sorted((x or "").replace(note, "") for x in cut) == sorted((x or "").replace(note, "") for x in texts)
    mixed = mixing.mixed_documents(docs, share=2.0).collect()
    assert sorted(r.text or "" for r in mixed) == sorted(2 * [x or "" for x in texts])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = [s for _, s in pipeline.STAGES]
    out = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for s in stage[:3]:
        out = s(spark, out, str(tmp_path))
    want = sorted(r.text for r in out.collect() if r.text and r.text.strip())
    assert len(want) == 17 and sum(note in x for x in want) == 1
    got = pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens").collect()
    assert len(got) >= 17 and any(r.doc_id is None for r in got)


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources", "byte-level BPE"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("more", F.lit(1))
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    out = pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert out.where("n_tokens <> size(ids)").count() == 0 and out.count() > 0
