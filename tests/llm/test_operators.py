"""Each operator against a brute-force version, a round trip or held-out accuracy, with the odd cases its docstring names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers as P
import pyarrow as pa
import pytest

from edgelab.llm import common, components, decontamination, embeddings, jaccard, langid, licence_texts, licences, quality, sentencepieces, token_orc, toxicity, warc

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "a"), (4, "word " * 30_000), (5, "a b c d e f g h"), (6, "a b c d e f g h"), (7, "  x \n\n y  ")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, at int, score double"


def odd(spark, rows=ODD):
    """Documents with nulls, ties, repeated rows, and columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, None, None, 5, 0.5) for i, t in [*rows, *rows[-1:]]], DOCS)


def test_warc(spark):
    inner = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = ["x" * 200, "x" * 200, None, "", "short", "short", "a" * 120 + "\r\n\r\n" + inner + "é" * 90, "WARC/1.0\r\n", "x" * 200, inner * 3]
    pages = spark.createDataFrame([(i, None, h, "z") for i, h in enumerate(html)], "page_id long, url string, html string, digest string")
    path = common.fresh_path(spark, "t")
    warc.write_archive(pages, path)
    for split in ("64", "16m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = {r["page_id"]: tuple(r)[1:] for r in warc.read_archive(spark, path).collect()}
        first = {}
        for i, h in enumerate(html):
            raw = (h or "").encode()
            d = hashlib.sha256(raw).hexdigest()
            again = len(raw) >= 100 and d in first
            assert got[i] == (len(raw), d, "revisit" if again else "response", first[d] if again else None)
            first.setdefault(d, i)
        assert len(got) == len(html)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")


def test_decontamination(spark):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(vocab, k=20)).capitalize() + ". " + " ".join(rng.choices(vocab, k=6)) + ".") for k in range(30)] + [(98, None), (99, "")]
    docs = []
    for d in range(120):
        words = rng.choices(vocab, k=rng.randint(0, 400))
        if d % 3 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = items[rng.randrange(30)][1].split()
        docs.append((d, " ".join(words)))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_hits(odd(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for d, t in docs:
        held = decontamination.shingles([x for x in map(decontamination.term, t.split()) if x])
        for k, text in items:
            own = decontamination.shingles([x for x in map(decontamination.term, (text or "").split()) if x])
            if own and len(own & held) >= 0.8 * len(own):
                want.add((d, k))
    assert got == want and len(want) >= 40
    index = decontamination.Index(items)
    for _ in range(50):  # block-max WAND against scoring everything
        terms = sorted({index.ids[w] for w in rng.sample(vocab, 60) if w in index.ids})
        full = {}
        for t in terms:
            for i, x in zip(index.items[t], index.impacts[t]):
                full[i] = full.get(i, 0) + x
        assert sorted(i for i, _ in index.retrieve(terms, 0.3)) == sorted(i for i, s in full.items() if s >= 0.3)
    assert decontamination.find_hits(odd(spark), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_toxicity(spark):
    docs, labels = common.table(spark, "/root/testdata/sf0.1", "documents"), common.table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.fit(docs, labels)
    x = toxicity.score(docs, model, ["doc_id"]).join(labels, "doc_id").filter(common.fold("doc_id", 3) == 1).toPandas()
    assert (x[x.toxic == 1].score >= 0.7).mean() > 0.8 and (x[x.toxic == 0].score < 0.7).mean() > 0.99
    chars = toxicity.CharModel(Counter({w: 50 for w in ("idiot", "moron", "clown", "the", "nothing", "little")}))
    assert [chars.restore(w) for w in ("1d10t", "m0r0n", "cl.o.w.n", "idiooooot")] == ["idiot", "moron", "clown", "idiot"]
    assert toxicity.spelled("you i d i o t now".split()) == ["idiot"]
    assert toxicity.score(odd(spark), model, ["doc_id"]).count() == len(ODD) + 1
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels), ["doc_id"]).count() == 0


def test_toxicity_counts_all_texts(spark):
    """The character model sees every document outside the held-out fold, labelled or not."""
    texts = ["The idiot, l'été: zażółć 12 gęślą_jaźń", "", None, "ΣΊΣΥΦΟΣ ab  ab", *(f"plain text {k} abcd" for k in range(40)), *("you fool" for _ in range(40))]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k >= 44)) for k in range(4, 84)], "doc_id long, toxic int")
    words = Counter(w for t in texts for w in re.findall(r"[^\W\d_]+", (t or "").lower()))
    want, got = toxicity.CharModel(words), toxicity.char_model(docs.repartition(3))
    letters = sorted(want.code)
    assert letters == sorted(got.code)
    order = [[0, *(m.code[c] for c in letters)] for m in (want, got)]
    assert np.allclose(*(m.log[np.ix_(o, o, o)] for m, o in zip((want, got), order)))
    kept = {c for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 3 != 1 for w in re.findall(r"[^\W\d_]+", (t or "").lower()) for c in w}
    assert set(toxicity.fit(docs, labels).chars.code) == kept and kept & set("żσ")


def test_toxicity_spacing_and_edges():
    words = "you idiot are such an clown moron dumbass the nothing little what a ass is it of to be in".split()
    chars = toxicity.CharModel(Counter({w: 50 for w in words}))
    for tokens, want in {
        "y o u i d i o t": {"you", "idiot"}, "i d i o t.": {"idiot"}, "i d 1 o t": {"idiot"}, "a s s": {"ass"}, "id i o t": {"idiot"},
        "!diot": {"idiot"}, "(lown": {"clown"}, "idio+": {"idiot"}, "dumba$$": {"dumbass"}, "@$$": {"ass"}, "you_are_an_" * 5 + "!d!0t": {"you", "are", "an", "idiot"}, "you_are_an_!d!0t": {"you", "are", "an", "idiot"},
    }.items():
        found = {w for t in [*tokens.split(), *toxicity.spelled(tokens.split(), " ")] for w in toxicity.token_words(t, chars)}
        assert want <= found, tokens
        model = toxicity.Model(chars, {w: 1.0 for w in want}, 0.0)
        z = toxicity.Scorer(model).scores(pa.array(["so b", tokens, None, f"the {tokens} nothing", "c d"]))
        assert np.allclose(np.log(z / (1 - z)), [0, len(want), 0, len(want), 0]), tokens
    assert "ass" not in toxicity.token_words("455", chars) and toxicity.spelled("it is of a to".split()) == []


def test_token_orc(spark):
    path = common.fresh_path(spark, "t")
    docs = odd(spark)
    token_orc.write_token_orc(docs, path, P.path("byte_bpe_50k.json"), 2, 3)
    got = sorted(map(tuple, token_orc.read_token_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    tokenizer = token_orc.WordEncoder(P.path("byte_bpe_50k.json")).tokenizer
    want, start = [], 0
    for i, t in sorted([*ODD, ODD[-1]], key=lambda x: x[0]):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    tricky = ["a\n  b   c \n d  ", "  x", "\x1ca!\x1c!b \x1cc", "don't 's  'll　z \xb2\xbd3", "<|endoftext|> hi", " ", "a\n \nb", "a  ", "a\n "]
    flat, at = token_orc.WordEncoder(P.path("byte_bpe_50k.json")).encode(tricky)
    assert [flat[a:z].tolist() for a, z in zip(at, at[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in tricky]


def test_quality(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    model = quality.fit(docs, labels)
    assert 0.7 < model.prior < 0.95
    x = quality.score(docs, model, ["doc_id"]).join(labels, "doc_id").filter(common.fold("doc_id", 4) == 2).toPandas()
    assert ((x.score >= 0.7).astype(int) == x.quality).mean() > 0.95
    assert quality.score(odd(spark), model, ["doc_id"]).count() == len(ODD) + 1
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels.limit(0)), ["doc_id"]).count() == 0


def brute_components(docs):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    label = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    return sorted((docs[k][0], len(sets[k]), min(docs[j][0] for j in range(len(docs)) if label[j] == label[k])) for k in range(len(docs)))


def test_jaccard(spark):
    rng = random.Random(5)
    vocab, docs = [f"v{k}" for k in range(300)], []
    passage = rng.choices(vocab, k=40)
    for g in range(12):
        base = rng.choices(vocab, k=rng.randint(5, 120)) + (passage if g % 2 else [])
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append((len(docs) + 10, " ".join(w)))
    docs += [(1, None), (2, ""), (3, "One Two"), (4, "one two"), (5, " \n"), (6, "a b c d e"), (7, "a b c d e f")]
    got = sorted(map(tuple, jaccard.join_components(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n long")).collect()))
    assert got == brute_components(docs)
    assert jaccard.keep_one(odd(spark)).filter("doc_id = 6").count() == 0 and jaccard.join_components(odd(spark).limit(0)).count() == 0


def test_keep_one_row_of_each_component(spark):
    rows = [(None, "alone with a null id a b c"), (None, "x y z twice under null ids"), (None, "x y z twice under null ids"), (1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six"), (3, "of its own a b c d"), (4, None), (5, "")]
    got = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(r["text"] or "" for r in got) == sorted(["", "", *{t for _, t in rows if t}])


def test_null_ids_keep_their_links(spark):
    words = [f"w{k}" for k in range(40)]
    rows = [(None, " ".join(words)), (7, " ".join([*words[:-1], "other"])), (8, "nothing like the rest at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.join_components(docs).collect()} == {(None, 7), (7, 7), (8, 8)}
    assert jaccard.keep_one(docs).count() == 2


def test_licences(spark):
    rows = [(1, "Copyright 2020 Someone\n" + licence_texts.MIT.upper().replace(",", "")), (2, "Text.\nReleased under the MIT Licence!\nmore"), (3, None), (4, ""), (5, licence_texts.ISC + " extra")]
    got = {r["doc_id"]: r for r in licences.scan(odd(spark, rows)).collect()}
    assert got[1]["text_licence"] == "MIT" and got[2]["notices"] == "MIT" and got[2]["text_licence"] is None
    assert got[3]["text_digest"] is None and got[4]["n_notices"] == 0 and got[5]["text_licence"] is None


def test_language(spark):
    docs = common.table(spark, SF, "documents")
    model = langid.fit(docs)
    x = langid.predict(docs, model, ["doc_id", "lang"]).filter(common.fold("doc_id", 3) == 1).toPandas()
    assert (x.lang == x.lang_pred).mean() > 0.98
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(odd(spark, [*ODD, (9, "123 !!")]), model, ["doc_id"]).collect()}
    assert got[1] == got[2] == got[9] == "und" and got[3] != "und"
    assert {r[1] for r in langid.predict(odd(spark), langid.fit(docs.limit(0)), ["doc_id"]).collect()} == {"und"}


def test_sentencepieces(spark):
    table = sentencepieces.PieceTable.load(P.path("piece_bpe_32k.model"))

    def plain(word):
        chars, best = sentencepieces.MARK + word, [(0, [])]
        for end in range(1, len(chars) + 1):
            options = [(best[s][0] + table.ids[chars[s:end]][0], best[s][1] + [table.ids[chars[s:end]][1]]) for s in range(end) if chars[s:end] in table.ids]
            raw = chars[end - 1].encode()
            options = options or [(best[end - 1][0] + sentencepieces.BYTE_SCORE * len(raw), best[end - 1][1] + [table.byte_ids[b] for b in raw])]
            best.append(max(options, key=lambda o: o[0]))
        return best[-1][0]

    words = ["the", "then", "thention", "Ökeit,", "x\ny", "日本", "", "thentions"]
    for w, ids in sentencepieces.shared_prefix_viterbi(words, table):
        score = sum(next(s for s, i in [table.ids[p] for p in table.ids if table.ids[p][1] == k]) if k not in table.byte_ids else sentencepieces.BYTE_SCORE for k in ids)
        assert score == pytest.approx(plain(w))
    out = sentencepieces.encode(odd(spark, [*ODD, (9, "a▁b  c\n")]), P.path("piece_bpe_32k.model"), ["doc_id"]).collect()
    assert all(r["restored"] for r in out) and {r["doc_id"]: r["n_pieces"] for r in out}[2] == 0


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(300):
        base = rng.normal(size=16)
        for _ in range(1 + k % 3):
            rows.append((len(rows), (base + rng.normal(size=16) * 0.1).astype(np.float32).tolist(), int(k % 2)))
    rows += [(5000, rows[0][1], 0), (5001, None, 0), (5002, [0.0] * 16, 0), (5003, [float("nan")] * 16, 0), (5004, rows[0][1], None), (5005, [], 0)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).toPandas().set_index("vec_id")
    links = {i: set() for i, _, _ in rows}
    for i, v, g in rows[:-5]:
        for j, w, h in rows[:-5]:
            if i != j and g == h:
                a, b = np.array(v, float), np.array(w, float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                    links[i].add(j)
    total, found = sum(map(len, links.values())), int(got.n_links.sum())
    assert found >= 0.95 * total and all(got.n_links[i] <= len(links[i]) for i in links)
    assert all(got.n_links[i] == 0 and got.component_id[i] == i for i in range(5001, 5006))


def test_components(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(1, 40)] + [(50, 51), (51, 51), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert {got[k] for k in range(1, 41)} == {1} and got[51] == 50


def test_pieces_keep_every_row():
    b = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (0, 5, 50, 5, 0)] + [None]})
    assert sum(p.num_rows for p in common.pieces(iter([b]), 10)) == 6
    assert pd.DataFrame(list(common.pieces(iter([b.slice(0, 0)])))).empty


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in common.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    assert 50 < len(out) < len(docs) and all(r["restored"] and len(r["ids"]) == r["n_pieces"] for r in out)
    kept = [(r["doc_id"], docs[r["doc_id"]]) for r in out]
    assert len({c for _, _, c in brute_components(kept)}) == len(kept)
