"""Odd cases that the operators' docstrings define, and brute-force versions on small tables."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_operators import ODD, SF, brute_components, odd

import corpus_pipeline
from edgelab.llm import common, decontamination, embeddings, jaccard, langid, licence_texts, licences, quality, sentencepieces, token_orc, toxicity, warc


def archive(spark, rows, schema="page_id long, url string, html string"):
    path = common.fresh_path(spark, "t")
    warc.write_archive(spark.createDataFrame(rows, schema), path)
    return path


def test_warc_null_ids_and_repeated_rows(spark):
    a, b, c = "a" * 150, "b" * 150, "c" * 150
    rows = [(3, "u", a), (None, "v", a), (None, "w", b), (None, "w", b), (7, "x", c), (7, "x", c), (7, "y", c), (8, None, c), (9, None, None), (9, None, None)]
    got = sorted(((r["page_id"], r["payload_digest"][:6], r["record_type"], r["refers_to"]) for r in warc.read_archive(spark, archive(spark, rows)).collect()), key=str)
    d = lambda x: hashlib.sha256(x.encode()).hexdigest()[:6]
    want = [(3, d(a), "response", None), (None, d(a), "revisit", 3), *[(None, d(b), "response", None)] * 2, (7, d(c), "response", None), *[(7, d(c), "revisit", 7)] * 2, (8, d(c), "revisit", 7), *[(9, d(""), "response", None)] * 2]
    assert got == sorted(want, key=str)


def test_warc_empty_long_and_broken(spark):
    assert warc.read_archive(spark, archive(spark, [])).count() == 0
    long = ("é" * 1000 + warc.MAGIC) * 2000
    got = warc.read_archive(spark, archive(spark, [(1, "u", long), (2, "u", "x")])).collect()
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in got}[1] == (len(long.encode()), hashlib.sha256(long.encode()).hexdigest())
    path = common.fresh_path(spark, "t")
    whole = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 1\r\n\r\na\r\n\r\n"
    spark.createDataFrame([(whole + whole.replace("Content-Length: 1\r\n", "") + whole[:-4],)], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(path)
    with pytest.raises(ValueError, match="chain of records"):
        warc.read_archive(spark, path)


def test_decontamination_blocks_long_items_and_odd_rows(spark, monkeypatch):
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(900)]
    items = [(k, " ".join(rng.choices(vocab, k=15 if k else 4000)) + ". " + " ".join(rng.choices(vocab, k=6)) + ".") for k in range(25)]
    docs = [(k, " ".join(rng.choices(vocab, k=50)) + " " + t + " tail") for k, t in items] + [(None, items[3][1]), (77, None), (78, ""), (79, items[4][1]), (79, items[4][1])]
    docs, items = odd(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    hits = lambda: sorted(((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in decontamination.find_hits(docs, items).collect()), key=str)
    one = hits()
    assert {(k, k) for k in range(25)} | {(None, 3), (79, 4)} <= {x[:2] for x in one} and sum(x[0] == 79 for x in one) == 3
    monkeypatch.setattr(decontamination, "ITEM_BLOCK", 7)
    assert hits() == one
    kept = decontamination.drop_contaminated(docs, items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [77, 78] and kept.columns == docs.columns
    assert decontamination.find_hits(docs.limit(0), items).count() == 0 and decontamination.drop_contaminated(docs, items.limit(0)).count() == docs.count()


def test_toxicity_ties_and_whole_texts(spark):
    chars = toxicity.CharModel(toxicity.Counter({w: 50 for w in ("idiot", "nothing", "little")}))
    assert "idiot" in toxicity.token_words("idi" + "o" * 400 + "t", chars)
    rows = [(k, ("you idiot " if k % 2 else "good day ") + "filler " * (40_000 if k == 41 else 3)) for k in range(60)]
    docs = odd(spark, rows)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(1, 1), (1, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model, docs.columns, "fresh").select("doc_id", "fresh").collect()
    assert len(got) == 61 and len({r["fresh"] for r in got if r["doc_id"] == 59}) == 1
    assert all((r["fresh"] >= 0.7) == bool(r["doc_id"] % 2) for r in got)


def test_token_orc_special_tokens_lookup_and_pruning(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tricky = ["<|endoftext|> hi", "a<|endoftext|>b", "hi  <|endoftext|>\n\n b <|endoftext|>", "x <|endoftext|>", "Ġa Ġ b", " \nfoo \tbar", "a \n"]
    flat, at = token_orc.WordEncoder(P.path("byte_bpe_50k.json")).encode(tricky)
    assert [flat[a:z].tolist() for a, z in zip(at, at[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in tricky]
    path = common.fresh_path(spark, "t")
    token_orc.write_token_orc(odd(spark).limit(0), path, P.path("byte_bpe_50k.json"), 2, 2)
    assert token_orc.read_token_index(spark, path).count() == 0
    path = common.fresh_path(spark, "t")
    docs = spark.range(20_000).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    token_orc.write_token_orc(docs, path, P.path("byte_bpe_50k.json"), 2, 2)

    def scanned(ids):
        """Rows that the ORC scan hands on, and those found."""
        df = token_orc.read_documents(spark, path, ids)
        found = [(r["doc_id"], list(r["ids"])) for r in df.collect()]
        plan = df._jdf.queryExecution().executedPlan()
        while plan.children().size():
            plan = plan.children().apply(0)
        return plan.metrics().apply("numOutputRows").value(), found

    rows, found = scanned([1234])
    assert found == [(1234, [*tokenizer.encode("text number 617", add_special_tokens=False).ids, 2])] and rows <= token_orc.ROW_INDEX_STRIDE
    rows, found = scanned([1235])  # within the range of a row group, but not in it: the Bloom filter tells
    assert found == [] and rows == 0


def test_quality_and_toxicity_match_plain_scoring(spark):
    """Each score again, from features of the text alone."""
    docs, labels = common.table(spark, "/root/testdata/sf0.001", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality.fit(common.table(spark, SF, "documents"), labels)
    for r in quality.score(docs, model, ["doc_id"]).collect():
        x = np.array([quality.style(texts[r["doc_id"]] or "")])
        z = ((x - model.mean) / model.scale * model.weights[:-1]).sum() + model.weights[-1]
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)
    model = toxicity.fit(common.table(spark, SF, "documents"), labels)
    for r in toxicity.score(docs, model, ["doc_id"]).collect():
        tokens = (texts[r["doc_id"]] or "").split()
        found = {f for t in {*tokens, *toxicity.spelled(tokens, " ")} for w in toxicity.token_words(t, model.chars) for f in toxicity.features(w)}
        z = model.bias + sum(model.weights.get(f, 0.0) for f in found)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -50, 50))), abs=1e-9)


def test_quality_long_and_repeated(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    long = docs.filter("doc_id < 400").withColumn("text", F.repeat("text", 30))
    assert quality.fit(long.unionByName(long), labels).weights.any()
    got = quality.score(odd(spark), quality.fit(docs, labels), odd(spark).columns, "fresh").filter("doc_id in (5, 6, 7)").collect()
    assert len({r["fresh"] for r in got if r["text"] == ODD[4][1]}) == 1 and sum(r["doc_id"] == 7 for r in got) == 2


def test_jaccard_cells_and_blocks(spark, monkeypatch):
    """A region far above the size of a cell: near copies that link with some of the others only."""
    rng = random.Random(4)
    base = [f"b{k}" for k in range(60)]
    docs = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"x{rng.randrange(9)}"
        docs.append((k, " ".join(w)))
    docs += [(200 + k, " ".join([*base[:30], *(f"y{k}-{j}" for j in range(30))])) for k in range(60)]
    docs += [(None, docs[0][1]), (999, "long " * 60_000), (998, None), (0, docs[0][1])]
    for cell, star in ((1024, 500), (12, 3)):
        monkeypatch.setattr(jaccard, "CELL", cell)
        monkeypatch.setattr(jaccard, "STAR", star)
        got = sorted(map(tuple, jaccard.join_components(odd(spark, docs)).collect()), key=str)
        want = brute_components([(10**9 if i is None else i, t) for i, t in [*docs, docs[-1]]])
        assert got == sorted(((None if i == 10**9 else i, n, c) for i, n, c in want), key=str)


def test_voronoi_cells_lose_no_pair():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 63, (300, jaccard.WINDOW_LONGS)).astype(np.uint64)
    words[150:] = words[:150]
    words[150:, 0] ^= rng.integers(0, 16, 150).astype(np.uint64)
    n, component = np.full(300, 400), np.arange(300)
    i, j, d = jaccard._near(words, n, component, np.ones(300, bool), 80)
    want = {(a, b) for a in range(300) for b in range(a) if int(np.bitwise_count(words[a] ^ words[b]).sum()) * 180 <= 800 * 20}
    assert {(max(a, b), min(a, b)) for a, b in zip(i.tolist(), j.tolist())} == want and len(want) >= 150


def test_licences_spelling_statements_and_texts(spark):
    one_line = "Copyright (c) 2020 Some One. All rights reserved. " + licence_texts.BSD_3
    rows = [(1, one_line), (2, "Copyright 2001 X\n\n" + licence_texts.BSD_2.replace("copyright holder", "Copyright  Owner")), (3, "licence licence licence"), (4, "license Licence license!"), (5, licence_texts.UNLICENSE), (6, licence_texts.APACHE_NOTICE), (7, None), (8, "Own words of a house licence"), (8, "Own words of a house licence")]
    got = licences.scan(odd(spark, rows), [*licence_texts.KNOWN, ("LicenseRef-house", "own words of a house license"), ("LicenseRef-a", "Own words of a house license.")]).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) + 1 and [by_id[k]["text_licence"] for k in (1, 2, 5, 6, 7, 8)] == ["BSD-3-Clause", "BSD-2-Clause", "Unlicense", "Apache-2.0", None, "LicenseRef-a"]
    assert by_id[3]["text_digest"] == by_id[4]["text_digest"] and licences.scan(odd(spark, rows).limit(0)).count() == 0


def plain_phrases(text: bytes, sample: bytes) -> int:
    count, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        count, at = count + 1, max(end - 1, at + 1)
    return count


def test_language_parses_whole_texts(spark, monkeypatch):
    rng = random.Random(1)
    sample = "".join(rng.choices("ab ", k=4000)) + "нет 日本"
    model = langid.Model({"x": langid.normalised(sample)[0]}, "t")
    texts = ["".join(rng.choices("abc ", [5, 5, 1, 2], k=n)) + rng.choice(["", "日x", "нет"]) for n in (1, 3, 50, 2500, 9000)] + ["a" * 5000, "c" * 3000]
    monkeypatch.setattr(langid, "BLOCK", 64)
    _, table, width, automaton, _ = langid._build(model)[0]
    blocks = langid.Blocks([langid.normalised(t)[0] for t in texts])
    got = np.bincount(blocks.text, langid.phrases(blocks, automaton, table, width), minlength=len(texts)) + 1
    breaks = lambda t: plain_phrases(t, model.samples["x"])
    for t, n in zip(texts, got):
        t = langid.normalised(t)[0]
        # Bytes that the sample lacks are phrases of their own, and the pass counts one more where one of them begins the text.
        assert abs(int(n) - breaks(t)) <= 1 + sum(b not in model.samples["x"] for b in t)
    known = [i for i, t in enumerate(texts) if all(b in model.samples["x"] for b in langid.normalised(t)[0])]
    assert known and all(got[i] == breaks(langid.normalised(texts[i])[0]) for i in known)


def test_language_ties_scripts_and_repeats(spark):
    rows = [(k, t, g) for k in range(40) for t, g in [(f"это русский текст номер {'аб' * (k % 5)}", "ru")]] + [(100 + k, f"αυτό είναι ελληνικό κείμενο {'αβ' * (k % 5)}", "el") for k in range(40)] + [(200, "это русский", None), (201, "ελληνικό", None), (201, "ελληνικό", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, bits int")
    model = langid.fit(docs.unionByName(docs))
    got = langid.predict(docs, model, docs.columns, ("a", "b", "c")).collect()
    assert {r["doc_id"]: r["a"] for r in got if r["doc_id"] >= 200} == {200: "ru", 201: "el"} and len(got) == len(rows)
    same = spark.createDataFrame([(k, "same words", g) for k, g in enumerate(["b", "a"] * 9)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(same, langid.fit(same), ["doc_id"]).collect()} == {("a", 0.0)}


def test_pieces_against_the_library(spark):
    model = P.path("piece_bpe_32k.model")
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").filter("text is not null")
    own = {r["doc_id"]: r for r in sentencepieces.encode(docs, model, ["doc_id"]).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    theirs = {r["doc_id"]: library.encode(r["text"]) for r in docs.collect()}
    # Whole paths of fewest pieces can't have more than greedy merges, but for literal marks and pieces that are not used.
    assert sum(r["n_pieces"] for r in own.values()) <= sum(map(len, theirs.values())) and all(r["restored"] for r in own.values())
    out = sentencepieces.encode(odd(spark, [(1, "x" * 50_000), (2, "日" * 3000)]), model, ["doc_id"]).collect()
    assert all(r["restored"] and zlib.crc32(np.array(r["ids"], "<i4").tobytes()) == r["ids_crc32"] for r in out) and out[1]["ids_crc32"] == out[2]["ids_crc32"]
    assert sentencepieces.encode(docs.limit(0), model, ["doc_id"]).count() == 0


def brute_links(rows, threshold=0.93):
    links = {k: set() for k in range(len(rows))}
    for k, (_, v, g) in enumerate(rows):
        for j, (_, w, h) in enumerate(rows):
            if k != j and g is not None and g == h and v and w and len(v) == len(w):
                a, b = np.array(v, float), np.array(w, float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[k].add(j)
    return links


def planted(rng, n, dim, low=0.93, high=0.96):
    """Vectors, each with a partner at a cosine between low and high."""
    rows = []
    for k in range(n):
        v = rng.normal(size=dim)
        v /= np.sqrt(v @ v)
        w = rng.normal(size=dim)
        w -= (w @ v) * v
        w /= np.sqrt(w @ w)
        c = rng.uniform(low, high)
        rows += [(2 * k, v.tolist(), k % 3), (2 * k + 1, (c * v + np.sqrt(1 - c * c) * w).tolist(), k % 3)]
    return rows


@pytest.mark.parametrize("split", [4096, 16])
def test_embedding_recall(spark, monkeypatch, split):
    monkeypatch.setattr(embeddings, "SPLIT", split)
    rows = planted(np.random.default_rng(5), 500, 64)
    links = brute_links(rows)
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).toPandas().set_index("vec_id")
    total = sum(map(len, links.values()))
    assert total >= 950 and got.n_links.sum() >= 0.9 * total and all(got.n_links[k] <= len(links[k]) for k in links)


def test_embedding_odd_rows(spark):
    rows = [(1, [1e300, 1.0], 0), (2, [1e300, 1.0], 0), (3, [1.0, 0.0, 0.0], 0), (4, [1e-200, 1e-200], 1), (4, [1e-200, 1e-200], 1), (5, [1.0, -1.0], 1), (None, [1.0, 0.0], 0), (6, [1.0, None], 0), (7, [], 0), (8, [0.0, 0.0], 0), (9, [float("inf"), 1.0], 0), (5, [-1.0, 1.0], 1)]
    docs = spark.createDataFrame([(*r, 5, b"x") for r in rows], "vec_id long, embedding array<double>, label int, n_links int, v binary")
    got = sorted((tuple(r) for r in embeddings.near_duplicates(docs).collect()), key=str)
    want = [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (5, 0, 5, True), (5, 0, 5, True), (None, 0, None, True), *((k, 0, k, True) for k in (6, 7, 8, 9))]
    assert got == sorted(want, key=str)
    assert embeddings.near_duplicates(docs.limit(0)).count() == 0


def test_stages_with_odd_rows(spark):
    """Nulls, repeated rows and columns named as the stages' own; every stage alone and on an empty table."""
    docs = common.table(spark, SF, "documents").withColumn("score", F.lit(1)).withColumn("Bits", F.lit(2)).withColumn("lang_pred", F.lit("z"))
    bad = docs.limit(3).withColumn("text", F.lit(None).cast("string")).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(2))
    docs = common.materialise(docs.unionByName(bad), "t")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() < docs.count(), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    out = corpus_pipeline.tokenised(spark, docs, SF)
    assert out.count() == docs.count() and corpus_pipeline.tokenised(spark, docs.limit(0), SF).count() == 0


def test_stages_against_plain_versions(spark):
    """What each stage keeps, by a version that looks at one text after another."""
    docs = common.table(spark, SF, "documents")
    rows = [r.asDict() for r in docs.collect()]
    model = langid.fit(docs, 3, 1)
    lang, _, bits = langid.predict_texts([r["text"] or "" for r in rows], model)
    want = [r["doc_id"] for r, g, b in zip(rows, lang, bits) if g != "und" and b <= model.most_bits[g]]
    assert sorted(want) == sorted(r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF).collect())
    judge = quality.fit(docs, common.table(spark, SF, "labels"), 4, 2)
    want = [r["doc_id"] for r in rows if judge.score(np.array([quality.style(r["text"] or "")]))[0] >= corpus_pipeline.LEAST_QUALITY]
    assert sorted(want) == sorted(r["doc_id"] for r in corpus_pipeline.good_quality(spark, docs, SF).collect())
    groups = {c for _, _, c in brute_components([(r["doc_id"], r["text"]) for r in rows])}
    assert sorted(groups) == sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    items = [[x for x in map(decontamination.term, (r["text"] or "").split()) if x] for r in common.table(spark, SF, "benchmark").collect()]
    held = {r["doc_id"]: [x for x in map(decontamination.term, (r["text"] or "").split()) if x] for r in rows}
    whole = {d for d, w in held.items() for i in items if i and any(w[k : k + len(i)] == i for k in range(len(w) - len(i) + 1))}
    kept = {r["doc_id"] for r in corpus_pipeline.decontaminated(spark, docs, SF).collect()}
    assert whole and not whole & kept and len(held) - len(kept) <= len(whole) + 20


def test_keep_one_writes_no_text_of_parquet_files(spark, monkeypatch, tmp_path):
    """Rows of files are named by where they lie, also under names that clash, whatever the splits; equal rows count one by one."""
    texts = ["one two three four five six", "one two three four five six", None, "", "of its own a b c d", *(f"t{k} " * 9 + "a b c d" for k in range(40))]
    rows = [(None if k == 4 else k // 2, t, "x", 1, 0) for k, t in enumerate(texts)] * 2
    path, written, write = str(tmp_path / "some docs"), [], common.materialise
    spark.createDataFrame(rows, "doc_id long, text string, file string, number int, _metadata int").repartition(5).write.parquet(path)
    monkeypatch.setattr(common, "materialise", lambda df, name: written.append(df.columns) or write(df, name))
    docs, seen = spark.read.parquet(path), []
    for split in ("1k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        keyed = jaccard._keyed(docs, lambda df: df).select("edgelab_row", "doc_id", "text").collect()
        assert len({r["edgelab_row"] for r in keyed}) == len(rows)
        seen.append(sorted(map(tuple, keyed)))
        got = jaccard.keep_one(docs)
        assert sorted(r["text"] or "" for r in got.collect()) == sorted(["", "", "", "", *{t for t in texts if t}]) and got.columns == docs.columns
    assert seen[0] == seen[1] and written and not any("text" in c for c in written)
    twice = spark.read.parquet(path, path)  # rows that lie in one place
    assert jaccard.keep_one(twice).count() == got.count() + 4 and any("text" in c for c in written)


def test_quality_holds_its_table_once():
    rng = np.random.default_rng(1)
    pos, unl = (rng.random((n, quality.FEATURES)).astype(np.float32) ** 3 + shift for n, shift in ((800, np.float32(0.1)), (1600, np.float32(0))))
    tracemalloc.start()
    model = quality.train(pos, unl, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    both = np.vstack([pos, unl]).astype(np.float64)
    assert peak < 1.5 * both.nbytes
    assert np.array_equal(model.mean, both.mean(axis=0)) and np.array_equal(model.scale, both.std(axis=0) + 0.02)
    got = quality.standardised(pos, unl)[0]
    assert np.array_equal(got[:, :-1], (both - model.mean) / model.scale) and (got[:, -1] == 1).all()
