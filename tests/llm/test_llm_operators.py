"""Each operator against a plain version on small and awkward tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, extra=()):
    """(id, text) pairs with clashing extra columns."""
    rows = [(i, t, "en" if k % 2 else "de", f"src{k % 3}" if k % 5 else None, 0) for k, (i, t) in enumerate(texts)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in extra:
        frame = frame.withColumn(name, F.lit("x"))
    return frame


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    rng = random.Random(3)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    long = prose(rng, 30_000)
    return [
        (1, base), (2, base.upper()), (3, base), (4, " ".join(near)), (5, None), (6, ""), (7, "   \n"), (8, "one two"), (9, "One TWO"), (10, long),
        (11, long + " more"), (12, "É é Ünï ÉÜ"), (13, "é é ünï éü"), (14, "1234 !!!"), (15, prose(rng, 50)), (15, prose(rng, 50)), (None, base), (None, None), (16, "x"),
    ] + [(100 + i, "copied text of a large group") for i in range(30)]


CLASHING = ("row", "key", "fp", "digest", "component_id", "_iv_row", "_iv_fp", "id", "tokens", "block", "pass", "score", "chunk", "ids", "keeper", "label")


def folded(text):
    return (text or "").encode().lower()


# ---------------------------------------------------------------- exact


def exact_plainly(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[folded(t)].append(i)
    return groups


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(spark, awkward, weak):
    from intervale.llm.exact_dedup import exact_duplicates

    options = {"digest": lambda c: (F.length(c) % 3).cast("string")} if weak else {}
    got = exact_duplicates(documents(spark, awkward, CLASHING), **options).collect()
    groups = exact_plainly(awkward)
    by_hash = {hashlib.sha256(t).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == len(awkward)
    for r in got:
        ids = by_hash[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (max(known) if known else None)
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.kept for r in got if r.group_size == 1)


def test_exact_empty_and_kept_columns(spark, awkward):
    from intervale.llm.exact_dedup import ExactDedup, exact_duplicates

    assert exact_duplicates(documents(spark, [])).count() == 0
    docs = documents(spark, awkward, CLASHING)
    kept = ExactDedup(docs).kept()
    assert kept.columns == docs.columns and kept.count() == len(exact_plainly(awkward))


def test_exact_over_many_micro_batches_and_calls(spark, awkward, tmp_path):
    from intervale.llm.exact_dedup import ExactDedup, exact_duplicates

    whole = sorted(map(tuple, exact_duplicates(documents(spark, awkward)).collect()), key=repr)
    one_file_each = documents(spark, awkward).repartition(7)
    small = exact_duplicates(one_file_each, files_per_trigger=1).collect()
    strip = lambda rows: sorted((r[0] if r[0] is not None else -1, r[1] if r[1] is not None else -1, r[2], r[4]) for r in rows)
    assert strip(small) == strip(whole) and sum(r.kept for r in small) == sum(r[3] for r in whole)
    folder = f"file://{tmp_path}/state"
    first = ExactDedup(documents(spark, awkward[:9]), folder=folder, files_per_trigger=1)
    assert first.kept().count() == len(exact_plainly(awkward[:9]))
    second = ExactDedup(documents(spark, awkward[9:]), folder=folder)
    rows = second.result()
    assert rows.count() == len(awkward) and second.kept().count() == len(exact_plainly(awkward))
    assert rows.select(second.row).distinct().count() == len(awkward)
    third = ExactDedup(documents(spark, []), folder=folder)
    assert third.kept().count() == len(exact_plainly(awkward))


def test_a_filter_lets_all_its_keys_through(spark):
    from intervale.llm.runtime import bit_filter

    keys = spark.range(0, 20_000, 7).select("id")
    rows = spark.range(20_000).withColumn("may", bit_filter(keys)(F.col("id")))
    assert rows.where("id % 7 = 0 and not may").count() == 0
    assert rows.where("id % 7 <> 0 and may").count() < 0.1 * 20_000
    assert spark.range(100).where(bit_filter(keys.where("id < 0"))(F.col("id"))).count() == 0


def test_ascii_lower_is_bytes_lower(spark):
    from intervale.llm.runtime import FOREIGN_CAPITAL, ascii_lower

    texts = ["ABC É İ Σς ǅ Ⓐ Ⅷ Ꭰ ß", "plain", "", "ÀÉ", "ⓐ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ascii_lower(F.col("t")).alias("low")).collect()
    assert all(r.low.encode() == r.t.encode().lower() for r in rows)
    changed = [chr(c) for c in range(128, 0x20000) if not 0xD800 <= c < 0xE000 and chr(c).lower() != chr(c)]
    seen = spark.createDataFrame([(c,) for c in changed], "c string").where(~F.col("c").rlike(FOREIGN_CAPITAL) & (F.lower("c") != F.col("c")))
    assert seen.count() == 0


# ---------------------------------------------------------------- simhash


def simhash_plainly(text, width=3):
    words = folded(text).split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components_plainly(ids, prints, distance=2):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash_documents(spark, awkward):
    from intervale.llm.simhash import near_duplicates

    got = near_duplicates(documents(spark, awkward, CLASHING)).collect()
    prints = [simhash_plainly(t) for _, t in awkward]
    want = components_plainly([i for i, _ in awkward], prints)
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(awkward, prints, want)), key=key)
    assert near_duplicates(documents(spark, [])).count() == 0


def test_every_close_pair_meets_at_an_anchor(spark, monkeypatch):
    from intervale.llm import simhash

    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63, 150)
    flip = lambda x, n: np.bitwise_xor.reduce([x, *[np.int64(1) << b for b in rng.choice(63, n, replace=False)]])
    prints = np.unique(np.concatenate((base, [flip(x, int(n)) for x in base for n in rng.integers(1, 4, 3)])))
    monkeypatch.setattr(simhash, "RESIDENTS", 1)
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 7)
    monkeypatch.setattr(simhash, "ROWS_AT_ONCE", 50)
    frame = spark.createDataFrame([(int(i), int(x)) for i, x in enumerate(prints)], "id long, fp long")
    for distance in (2, 3):
        groups = simhash.group_rows(frame, simhash.Scratch(simhash.prepare(spark), "t"), distance)
        got = {r.fp: r.component for r in groups.collect()}
        want = components_plainly(list(range(len(prints))), [int(x) & (2**64 - 1) for x in prints], distance)
        assert [got.get(int(x), i) for i, x in enumerate(prints)] == want


def test_one_of_each_near_group_stays(spark, awkward):
    from intervale.llm.simhash import without_near_duplicates

    docs = documents(spark, awkward, CLASHING)
    got = without_near_duplicates(docs, width=3, distance=2)
    prints = [simhash_plainly(t) for _, t in awkward]
    marked = components_plainly(list(range(len(awkward))), prints)
    assert got.columns == docs.columns and got.count() == len(set(marked))


def similar_plainly(texts, least=0.8):
    shingles = []
    for t in texts:
        w = folded(t).split()
        shingles.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(shingles[i] & shingles[j]) >= least * len(shingles[i] | shingles[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_similar_texts_go(spark, awkward):
    from intervale.llm.simhash import without_similar

    rng = random.Random(21)
    rows = list(awkward)
    for k in range(25):
        base = prose(rng, 200).split()
        for copy in range(5):
            words = list(base)
            for _ in range(copy):
                words[rng.randrange(200)] = "changed"
            rows.append((1000 + 10 * k + copy, " ".join(words)))
    docs = documents(spark, rows, CLASHING)
    got = without_similar(docs)
    assert got.columns == docs.columns
    marks = similar_plainly([t for _, t in rows])
    n = len(set(marks))
    assert got.count() == n
    assert {r.doc_id for r in got.collect()} >= {min(i for m, (i, _) in zip(marks, rows) if m == k and i is not None) for k in set(marks) if any(m == k and i is not None for m, (i, _) in zip(marks, rows))}
    assert without_similar(documents(spark, [])).count() == 0


def kept_ids(spark, rows):
    from intervale.llm.simhash import without_similar

    return {r.doc_id for r in without_similar(documents(spark, rows)).collect()}


def first_of_each(rows):
    return {min(i for (i, _), m in zip(rows, marks) if m == k) for marks in [similar_plainly([t for _, t in rows])] for k in set(marks)}


def fresh(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_similar_pairs_behind_unrelated_texts(spark):
    rng = random.Random(34)
    shared, rows = fresh(rng, 150), []
    for k in range(150):  # all texts share a passage and 0.65 of each other; only two at a time are similar
        own = fresh(rng, 40)
        rows += [(10 * k, " ".join(shared + own)), (10 * k + 1, " ".join(shared + own[:-14] + fresh(rng, 14)))]
    assert kept_ids(spark, rows) == {10 * k for k in range(150)}


def test_rounds_of_one_text_a_key_lose_no_pair(spark, monkeypatch):
    from intervale.llm import simhash

    rng = random.Random(31)
    lines, rows = [fresh(rng, 30) for _ in range(6)], []
    for k in range(40):  # texts of the same few passages, in part alike, in part not
        words = sum(rng.sample(lines, 4), [])
        for copy in range(3):
            at = rng.randrange(len(words))
            rows.append((10 * k + copy, " ".join(words[:at] + fresh(rng, copy) + words[at:])))
    for name, value in (("PAIRS_AT_ONCE", 7), ("FEW_PAIRS", 0), ("PAIRS_AN_ENTRY", 0), ("STAR_ROUNDS", 2), ("FEW_SETS", 1), ("ENTRIES_A_BLOCK", 5)):
        monkeypatch.setattr(simhash, name, value)
    assert kept_ids(spark, rows) == first_of_each(rows)


@pytest.mark.parametrize("held", [1, 7, 1000])
def test_pairs_do_not_depend_on_how_keys_are_taken_in(spark, monkeypatch, held):
    """Keys of one to many entries, over batches of Arrow of a few rows: every pair of different roots of a key, once."""
    from fractions import Fraction

    from intervale.llm import simhash

    monkeypatch.setattr(simhash, "ENTRIES_HELD", held)
    monkeypatch.setattr(simhash, "ENTRIES_A_TASK", 50)
    sizes = [1, 2, 3, 9, 30, 1, 12]
    rows = [(key, 100 * key + i, 10, 0, 100 * key + i // 2, b"\0" * 64) for key, n in enumerate(sizes) for i in range(n)]
    entries = spark.createDataFrame(rows, "key long, cid long, n long, pos long, root long, odd binary")
    hot = spark.createDataFrame([(4, 3)], "key long, blocks long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = sorted(map(tuple, simhash.candidate_pairs(entries, hot, Fraction(4, 5), None, len(rows)).collect()))
        star = simhash.candidate_pairs(entries.drop("odd"), hot, Fraction(4, 5), 0, len(rows)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = [(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[4] != b[4]]
    assert got == sorted(want) and set(map(tuple, star)) <= set(want) and len(star) < len(want)


def test_every_pair_at_the_least_similarity_meets(spark):
    rng = random.Random(32)
    rows = []
    for k in range(150):  # 4 of 5 shingles are shared: 160 of 200, and one less
        words = fresh(rng, 184)
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(words[:164] + fresh(rng, 20))), (10 * k + 2, " ".join(words[:163] + fresh(rng, 21) if k % 2 else fresh(rng, 9)))]
    assert kept_ids(spark, rows) == first_of_each(rows)


def test_a_repeated_line_makes_no_link(spark):
    rng = random.Random(33)
    line = fresh(rng, 10)
    rows = [(k, " ".join(line * 50 + fresh(rng, 100))) for k in range(6)]
    assert kept_ids(spark, rows) == set(range(6))


@pytest.mark.parametrize("one_task", [0, 60, 1 << 20])
def test_components_of_a_long_path(spark, monkeypatch, one_task):
    from intervale.llm import components as module
    from intervale.llm.components import components
    from intervale.llm.runtime import Scratch

    monkeypatch.setattr(module, "ONE_TASK", one_task)
    n = 200
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = [(a, b) for a, b in zip(order, order[1:])] + [(1000, 1001), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


# ---------------------------------------------------------------- pieces


@pytest.fixture(scope="session")
def codec():
    from intervale.llm.sentencepiece_unigram import Codec, load

    return Codec(load(public_tokenizers.path("piece_bpe_32k.model")))


def viterbi_plainly(codec, pieces, text):
    """The best score over all segmentations of the marked text."""
    s = ("▁" + text.replace(" ", "▁")) if text else ""
    table = {pieces.names[i]: pieces.scores[i] for i in {v for v in codec.value if v >= 0}}
    best = [0.0] + [-math.inf] * len(s)
    for i in range(len(s)):
        for j in range(i + 1, min(len(s), i + 20) + 1):
            if s[i:j] in table:
                best[j] = max(best[j], best[i] + table[s[i:j]])
        if s[i] not in table:
            best[i + 1] = max(best[i + 1], best[i] + codec.unknown_score)
    return best[-1]


TEXTS = ["", " ", "hello world", "  two  spaces ", "line\n\nbreak \n x", "日本語 🎉 ok", "naïve Straße\tTab", "%%% $$$ ***", "a" * 300, "\x00\x7f"]


@pytest.mark.parametrize("text", TEXTS)
def test_pieces_best_score_and_round_trip(codec, text):
    from intervale.llm.sentencepiece_unigram import load

    pieces = load(public_tokenizers.path("piece_bpe_32k.model"))
    ids, score = codec.encode(text)
    assert abs(score - viterbi_plainly(codec, pieces, text)) < 1e-6
    assert codec.decode(ids.tolist()) == text


def test_pieces_against_the_library(codec):
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    from intervale.llm.sentencepiece_unigram import load

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = load(path)
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for i, p in enumerate(model.pieces):
        p.score = pieces.scores[i]
    library = SentencePieceProcessor(model_proto=model.SerializeToString())
    rng = random.Random(4)
    for text in TEXTS[:7] + [prose(rng, 40) for _ in range(5)]:
        assert codec.encode(text)[0].tolist() == library.encode(text)


def test_trie_holds_its_keys_and_no_other():
    from intervale.llm.sentencepiece_unigram import DoubleArray

    rng = random.Random(9)
    keys = {bytes(rng.choices(b"abc\xff\x00", k=rng.randint(1, 6))): i for i in range(300)}
    trie = DoubleArray.build(keys)

    def find(key):
        s = 0
        for b in key:
            t = trie.base[s] + b + 1
            if trie.check[t] != s:
                return -1
            s = t
        return trie.value[s]

    for key in list(keys) + [bytes(rng.choices(b"abcd", k=4)) for _ in range(200)]:
        assert find(key) == keys.get(key, -1)


def test_piece_columns(spark, awkward):
    from intervale.llm.sentencepiece_unigram import SentencePieces, piece_digests

    path = public_tokenizers.path("piece_bpe_32k.model")
    got = piece_digests(documents(spark, awkward, CLASHING), path).collect()
    assert len(got) == len(awkward) and all(r.round_trip for r in got)
    pieces = SentencePieces(spark, path)
    back = documents(spark, awkward).select("text", pieces.decode(pieces.encode(F.col("text"))).alias("back")).collect()
    assert all(r.back == (r.text or "") for r in back)
    assert piece_digests(documents(spark, []), path).count() == 0


# ---------------------------------------------------------------- token files


def test_rans_round_trip_and_checkpoints():
    from intervale.llm.rans import CHECKPOINT, Coder, Corrupt, Frequencies

    rng = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 5), (7, 1), (5000, 300), (70_000, 40_000)):
        ids = (rng.zipf(1.4, n) % top).astype(np.int64)
        coder = Coder(Frequencies.scale(*np.unique(ids, return_counts=True)))
        assert int(coder.table.counts.sum()) in (0, 1 << coder.table.bits)
        block = coder.encode(ids, 64)
        assert (coder.decode(block) == ids).all()
        marks = len(block.checkpoints) // (8 * 65)
        for k in range(marks + 1):
            assert (coder.decode(block, k, k + 1) == ids[k * CHECKPOINT * 64 : (k + 1) * CHECKPOINT * 64]).all()
    words = bytearray(block.words)
    words[10] ^= 1
    with pytest.raises(Corrupt):
        coder.decode(type(block)(**(block.__dict__ | {"words": bytes(words)})))


def test_token_files(spark, awkward, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    from intervale.llm import token_files

    path = public_tokenizers.path("word_bpe_49k.json")
    odd = [(200, "Hello WORLD... it's don't, 'tis"), (201, "a,-b ,. x."), (202, "<|endoftext|> x"), (203, "É̂ é. İstanbul ΣΑΣ x\x1cy\x85z 123.45, 6.")]
    rows = awkward + odd
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 3000)
    folder = f"file://{tmp_path}/tokens"
    token_files.write_files(documents(spark, rows, CLASHING), path, folder)
    got = token_files.read_digests(spark, folder).collect()
    library = Tokenizer.from_file(path)
    ids = {k: np.array(library.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4") for k, (_, t) in enumerate(rows)}
    assert sorted((r.doc_id is not None, r.doc_id, r.n_tokens, r.ids_crc32) for r in got if r.doc_id is not None) == sorted((True, d, len(ids[k]), zlib.crc32(ids[k].tobytes())) for k, (d, _) in enumerate(rows) if d is not None)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0] + [r.n_tokens for r in ordered])[:-1].tolist()
    known = [r.doc_id for r in ordered if r.doc_id is not None]
    assert known == sorted(known) and [r.doc_id for r in ordered[:2]] == [None, None]
    whole = {(r.doc_id, tuple(r.ids)) for r in token_files.read_ids(spark, folder).collect()}
    assert whole == {(d, tuple(ids[k].tolist())) for k, (d, _) in enumerate(rows)}
    token_files.write_files(documents(spark, []), path, folder + "-none")
    assert token_files.read_digests(spark, folder + "-none").count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_ids_are_those_of_the_library(name):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from intervale.llm import token_files

    with open(public_tokenizers.path(name)) as f:
        tokenizer = token_files.WordTokenizer(f.read())
    assert tokenizer.by_words == (name == "word_bpe_49k.json")
    library = Tokenizer.from_file(public_tokenizers.path(name))
    rng = random.Random(5)
    signs = "aAbBzZ .,'\n\t\x01\x1c\x0b!?-09éÉßΣσςİ中文ｱ🎉\u0301\u00a0\u3000<|>’“ſKÅ한กำ"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["<|endoftext|> a", "it's I'll 'S.", "", None, "..., a., b.. c.,", "w" * 500, "x" * 70 + " " + "x" * 70]
    for _ in range(2):  # the second time from memory
        ids, counts = tokenizer.encode(pa.array([None if t is None else t.encode() for t in texts], pa.binary()))
        at = 0
        for t, n in zip(texts, counts.tolist()):
            assert ids[at : at + n].tolist() == library.encode(t or "", add_special_tokens=False).ids + [1]
            at += n
    assert not any(len(w) > token_files.REMEMBERED_BYTES for w in tokenizer.store.of) if tokenizer.by_words else True


def test_a_full_store_forgets_and_learns_again():
    from intervale.llm.unit_store import UnitStore

    store = UnitStore(np.int32, most_units=5, most_bytes=3)
    learn = lambda units: store.add(np.concatenate([[len(u)] * len(u) for u in units]), np.array([len(u) for u in units]))
    for units in ([b"a", b"bb", b"cccc"], [b"bb", b"d", b"ee", b"fff"], [b"a", b"ggg", b"cccc", b"h"], [b"a", b"fff"]):
        store.tidy()
        slots = store.slots(units, learn)
        lengths = store.lengths(slots)
        assert store.gather(slots, lengths).tolist() == sum([[len(u)] * len(u) for u in units], [])
        assert b"cccc" not in store.of
    assert len(store.of) <= 5


# ---------------------------------------------------------------- mixing


def test_exponent_meets_its_target():
    from intervale.llm.mixing import bisect_exponent, entropy, weights

    shares = [0.6, 0.3, 0.08, 0.02]
    a = bisect_exponent(shares, max_repeat=3.0)
    passes = [w / p for w, p in zip(weights(shares, a), shares)]
    assert abs(max(passes) / min(passes) - 3.0) < 1e-9
    b = bisect_exponent(shares, target_entropy=1.2)
    assert abs(entropy(weights(shares, b)) - 1.2) < 1e-9
    assert bisect_exponent(shares, max_repeat=1e9) == 0.0 and bisect_exponent([], max_repeat=2.0) == 1.0


def test_mixture_loses_no_document_and_keeps_its_quotas(spark, awkward):
    from intervale.llm.mixing import Mixture, mixed_sources

    rng = random.Random(8)
    rows = [(i, prose(rng, 5 + i % 7), "en", "big" if i % 10 < 8 else "small", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixture = Mixture(docs, max_repeat=2.0, block_docs=16)
    drawn = mixture.draws().select("row.doc_id", "key", "tokens", "block", "pass").collect()
    shares = {s.key: s for s in mixture.shares}
    assert {r.doc_id for r in drawn} == set(range(300))
    assert len({(r.doc_id, r["pass"]) for r in drawn}) == len(drawn)
    for key, share in shares.items():
        spent = sum(r.tokens for r in drawn if r.key == key)
        assert share.quota - 12 <= spent <= share.quota
    cut = Mixture(docs, max_repeat=2.0, block_docs=16, budget=1000).draws().agg(F.sum("tokens").alias("t")).first().t
    assert 970 <= cut <= 1000
    odd = documents(spark, awkward, CLASHING)
    mixed = Mixture(odd).documents()
    assert mixed.columns == odd.columns and mixed.select("doc_id").distinct().count() == len({i for i, _ in awkward})
    assert mixed_sources(documents(spark, [])).count() == 0


# ---------------------------------------------------------------- language


def test_suffix_automaton_knows_every_factor():
    from intervale.llm.language_id import suffix_automaton

    rng = random.Random(5)
    s = [rng.randrange(3) for _ in range(60)]
    step = suffix_automaton(s)
    factors = {tuple(s[i:j]) for i in range(60) for j in range(i, 61)}
    for _ in range(500):
        word = tuple(rng.randrange(3) for _ in range(rng.randrange(1, 8)))
        state = 0
        for c in word:
            state = step[state].get(c) if state is not None else None
        assert (state is not None) == (word in factors)


def test_phrases_are_a_greedy_parse():
    from intervale.llm.language_id import BLOCK, Model, Parser

    rng = random.Random(6)
    model = Model((("a", prose(rng, 300)), ("b", prose(rng, 300)[::-1])))
    parser = Parser(model)
    texts = [prose(rng, n) for n in (3, 200, 1)] + ["zzz qqq"]
    got = parser.phrases([parser.squeeze(parser.encode(t)) for t in texts])
    for row, text in zip(got, texts):
        symbols = parser.squeeze(parser.encode(text)).tolist()
        for lang, (_, source) in enumerate(model.texts):
            held = "".join(map(chr, parser.squeeze(parser.encode(source)).tolist()))
            count = 0
            for at in range(0, len(symbols), BLOCK):
                block = "".join(map(chr, symbols[at : at + BLOCK]))
                i = 0
                while i < len(block):
                    j = i + 1
                    while j < len(block) and block[i : j + 1] in held:
                        j += 1
                    count, i = count + 1, j
            assert row[lang] == count


def test_language_columns(spark, awkward):
    from intervale.llm.language_id import Model, fit, identify

    rng = random.Random(7)
    known = documents(spark, [(i, prose(rng, 80) if i % 2 else prose(rng, 80)[::-1]) for i in range(40)])
    model = fit(known.withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "greek").otherwise("keerg")))
    got = identify(documents(spark, awkward, CLASHING), model).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(awkward) and all(0 <= r.score <= 1 for r in got)
    assert [by_id[i].lang_pred for i in (5, 6, 7, 14)] == ["und"] * 4 and by_id[1].lang_pred == by_id[10].lang_pred == "greek"
    assert {r.lang_pred for r in identify(documents(spark, awkward), Model(())).collect()} == {"und"}
    assert fit(documents(spark, [])) == Model(()) and identify(documents(spark, []), model).count() == 0


def test_one_long_text_does_not_fill_the_sample(spark):
    from intervale.llm.language_id import fit

    rows = [(i, f"{chr(97 + i)}" * 5000) for i in range(20)] + [(50, "zz")]
    docs = documents(spark, rows).withColumn("lang", F.lit("x"))
    (_, text), = fit(docs, chars=1000).texts
    assert {c for c in text if c.isalpha()} == {chr(97 + i) for i in range(20)} | {"z"} and 900 <= len(text) <= 1000


def test_language_sample_is_bounded(spark):
    """Null and equal ids, equal rows, long texts and many languages bring no more than the sample's rows and characters."""
    from intervale.llm import language_id as li

    null_ids = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"), F.lit("x").alias("lang"))
    same_id = null_ids.withColumn("doc_id", F.lit(7).cast("long"))
    equal = null_ids.withColumn("text", F.lit("the same text"))
    assert li.sampled(null_ids, rows=400, chars=1000).count() == 400 and li.sampled(same_id, rows=400, chars=1000).count() == 400
    assert li.sampled(equal, rows=400, chars=1000).count() == 1 and li.sampled(null_ids.limit(0), rows=400, chars=9).count() == 0
    long = spark.range(30).select("id", F.concat(F.repeat(F.lit("a"), 5000), F.repeat(F.lit("b"), 5000)).alias("text"), F.lit("x").alias("lang"))
    cut = [r.text for r in li.sampled(long, id_col="id", rows=100, chars=50).collect()]
    assert {len(t) for t in cut} == {50} and {t[0] for t in cut} == {"a", "b"}  # from places all over the text
    assert {"a", "b"} <= set(li.fit(long, id_col="id", chars=2000).texts[0][1])
    many = spark.range(3000).select("id", F.repeat(F.col("id").cast("string"), 300).alias("text"), (F.col("id") % 50).cast("string").alias("lang"))
    model = li.fit(many, id_col="id", chars=800)
    assert len(model.texts) == 50 and all(0 < len(t) <= 800 for _, t in model.texts)


def test_signs_beyond_the_letter_table_are_no_letters():
    from intervale.llm.language_id import Model, Parser

    got = Parser(Model((("a", "some words"), ("b", "other words")))).predict(["\U0001f389\U0001f600", "\ue000", "\uff01\uff1f", "\u6f22\u5b57"])
    assert [name for name, _ in got[:3]] == ["und"] * 3 and got[3][0] != "und"


def test_a_large_alphabet_needs_little_memory():
    from intervale.llm.language_id import Model, Parser

    rng = random.Random(4)
    signs = [chr(0x4E00 + i) for i in range(3000)]
    parser = Parser(Model(tuple((x, "".join(rng.choices(signs, k=8000))) for x in "ab")))
    assert sum(x.nbytes for x in (parser.base, parser.check, parser.to, parser.start)) < 4 << 20
    assert [p[0] for p in parser.predict(["\U0001f389\u3001\u300c\u300d\uff11\uff12", "", None])] == ["und"] * 3


def test_language_accuracy_on_held_out_documents(spark):
    from intervale.llm.queries import op6_language_id

    rows = op6_language_id(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id")
    held = rows.where("held_out and lang is not null")
    assert held.where("lang_pred = lang").count() >= 0.97 * held.count()


# ---------------------------------------------------------------- quality


def test_rules_as_columns_equal_rules_as_arrays(spark, awkward):
    from intervale.llm.quality_rules import FEATURES, fit, fit_ensemble, score, statistics

    rng = random.Random(8)
    good = [(i, prose(rng, 60)) for i in range(60)]
    bad = [(100 + i, " ".join(w.upper() + "!!" for w in prose(rng, 60).split())) for i in range(30)]
    docs = documents(spark, good + bad, CLASHING)
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (1, None)], "doc_id long, quality int")
    model = fit(docs, labels)
    got = {r.doc_id: r.score for r in score(docs, model).collect()}
    x = np.array([statistics(t.encode()) for _, t in good + bad])
    assert x.shape[1] == len(FEATURES)
    for (i, _), s in zip(good + bad, model.scores(x)):
        assert abs(got[i] - s) < 1e-9
    assert min(got[i] for i, _ in good) > 0.7 > 0.3 > max(got[i] for i, _ in bad)
    rows = score(documents(spark, awkward), model).collect()
    assert len(rows) == len(awkward) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert fit_ensemble(np.zeros((0, len(FEATURES))), np.zeros(0)).rules == ()


def test_a_rule_ensemble_by_hand():
    """The lasso's optimum, and a score, from their definitions."""
    from intervale.llm.quality_rules import Ensemble, Rule, _lasso

    rng = np.random.default_rng(3)
    x = (rng.random((300, 6)) < 0.4).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1.5 * x[:, 1] - 0.3)))).astype(float)
    base, w = _lasso(x, y, 0.02, rounds=3000)
    spread = x.std(axis=0) + 1e-9
    loss = lambda b, v: np.mean(np.logaddexp(0, b + x @ v) - y * (b + x @ v)) + 0.02 * np.abs(v * spread).sum()
    for _ in range(300):
        step = rng.normal(size=7) * 10 ** rng.uniform(-4, 0)
        assert loss(base, w) <= loss(base + step[0], w + step[1:]) + 1e-9
    assert (w != 0).sum() < 6 and w[0] > 0 > w[1]
    model = Ensemble(0.5, (1.0, -2.0), (Rule(((0, True, 0.5),)), Rule(((0, False, 0.5), (1, True, 0.5)))))
    assert np.allclose(model.scores(np.array([[1.0, 0.0], [0.0, 1.0], [0.0, 0.0]])), 1 / (1 + np.exp([-1.5, 1.5, -0.5])))


def test_quality_on_held_out_documents(spark):
    from intervale.llm.queries import op7_quality

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = op7_quality(spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    assert len(held) > 50 and sum(r.predicted == r.quality for r in held) >= 0.9 * len(held)
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) >= 0.95


def test_quality_without_labels_or_rows(spark, awkward):
    from intervale.llm.quality_rules import fit, score

    docs = documents(spark, awkward)
    none = spark.createDataFrame([(1, None), (2, None)], "doc_id long, quality int")
    for labels in (none, none.where("false")):
        assert {r.score for r in score(docs, fit(docs, labels)).collect()} == {0.5}
    assert score(documents(spark, []), fit(documents(spark, []), none)).count() == 0


# ---------------------------------------------------------------- neighbours


def test_neighbours(spark):
    from intervale.llm.additive_ann import nearest

    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16))
    x[100:160] = x[100]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (700, []), (800, [0.0] * 16), (900, [float("nan")] + [1.0] * 15), (1000, [None] + [1.0] * 15), (None, x[0].tolist()), (1100, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("row", F.lit(1))
    got = nearest(frame, every=50, k=10, books=12, size=32).collect()
    y = x.astype(np.float32).astype(np.float64)
    hits = 0
    for q in range(0, 600, 50):
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = sorted(range(600), key=lambda i: (d[i], i))[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, *_ in mine] == list(range(1, 11)) and all(abs(s - d[v]) < 1e-9 for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & set(want))
        if q == 100:
            assert [v for _, v, _ in mine] == want
    assert hits >= 0.9 * 120
    assert nearest(frame.where("false")).count() == 0
    few = nearest(frame.where("vec_id < 4"), every=2, k=10).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(q, k) for q in (0, 2) for k in (1, 2, 3)]


def test_many_equal_vectors_leave_room_for_others(spark):
    from intervale.llm.additive_ann import nearest

    rng = np.random.default_rng(5)
    x = rng.normal(size=(1600, 8))
    x[:1300] = x[0]  # more copies than are ranked again, stored in the order of falling ids
    frame = spark.createDataFrame([(i, x[i].tolist()) for i in range(1599, -1, -1)], "vec_id long, embedding array<double>").repartition(1)
    got = nearest(frame.orderBy(F.desc("vec_id")), every=1599, k=10, books=8, size=16).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0] == list(range(1, 11))
    d = ((x - x[1599]) ** 2).sum(axis=1)
    d[1599] = np.inf
    want = sorted(range(1600), key=lambda i: (d[i], i))[:10]
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 1599] == want


def nearest_plainly(x, ids, q, k):
    d = np.sqrt(np.add.accumulate((x - x[q]) ** 2, axis=1)[:, -1])
    d[q] = np.inf
    return [ids[i] for i in sorted(range(len(x)), key=lambda i: (d[i], ids[i]))[:k]]


@pytest.mark.parametrize("offset", [0.0, 1e5, -1e12])
def test_an_offset_changes_no_neighbour(spark, offset):
    from intervale.llm.additive_ann import nearest

    rng = np.random.default_rng(6)
    x = rng.normal(size=(1200, 16)) * max(1.0, abs(offset) / 1e6) + offset
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(frame, every=200, k=10, books=12, size=32).collect()
    hits = sum(len({r.vec_id for r in got if r.query_id == q} & set(nearest_plainly(x, range(len(x)), q, 10))) for q in range(0, 1200, 200))
    assert hits >= 0.9 * 60


def test_exact_neighbours_and_many_equal_vectors(spark, monkeypatch):
    from intervale.llm import additive_ann as ann

    monkeypatch.setattr(ann, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 12))
    x[500:2500] = x[500]
    x[2700] = 1e200
    ids = [int(i) for i in rng.permutation(3000)]
    frame = spark.createDataFrame([(ids[i], v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = ann.Index(frame, books=6, size=16)
    asked = [ids.index(0), ids.index(7), ids[2700] and 2700, 600]
    got = index.search(index.vectors.where(F.col("vec_id").isin([ids[q] for q in asked])), k=10, rerank=20, exact=True).collect()
    for q in asked:
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == ids[q]] == nearest_plainly(x, ids, q, 10)


# ---------------------------------------------------------------- licences


def test_whole_licences_are_known(spark):
    from pathlib import Path

    from intervale.llm import licences

    files = sorted(Path(licences.__file__).with_name("licence_files").glob("*.txt"))
    rows = [(i, p.read_text().upper()) for i, p in enumerate(files)]
    got = {r.doc_id: r.licence for r in licences.scan(documents(spark, rows)).collect()}
    assert files and [got[i] for i in range(len(files))] == [p.stem for p in files]


def test_licences(spark, awkward):
    from intervale.llm.licence_texts import MIT
    from intervale.llm.licences import canonical, scan

    changed = "MIT Licence\n\nCopyright (c) 2024 Some Person\nAll rights reserved.\n" + MIT.upper().replace("SUBLICENSE", "sub-license").replace('"', "'")
    rows = [(1, MIT), (2, changed), (3, MIT + " and more"), (4, "x"), (5, None), (6, "...")] + [(50 + i, t) for i, t in awkward if i is not None]
    got = {r.doc_id: r.licence for r in scan(documents(spark, rows, CLASHING)).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5, 6)] == ["MIT", "MIT", None, None, None, None]
    assert canonical("The copyright holder, while authorised:\n 2. x") == "the copyright owner while authorized x"
    assert scan(documents(spark, [])).count() == 0


def canonical_plainly(text):
    """The rules one after another, word by word."""
    import re

    from intervale.llm.licences import PHRASES, SPELLINGS

    lines = []
    for line in (text or "").lower().split("\n"):
        bare = re.sub(r"^[\W_]+", "", line)
        named = re.match(r"copyright\b", bare) and re.search(r"\(c\)|©|\d{4}|<|\[|\bby\b", bare[9:])
        if named or re.match(r"[\W_]*(\(c\)|©|all rights reserved)", line):
            continue
        lines.append(re.sub(r"^[^\S\n]*(?:[0-9]{1,2}|[a-z])[.)][^\S\n]+", "", line))
    same = {b: a for a, b in (x.split() for x in SPELLINGS.strip().splitlines())}
    words = [same.get(w, w) for w in re.findall(r"[^\W_]+", "\n".join(lines))]
    out = f" {' '.join(words)} "
    for rule in PHRASES.strip().splitlines():
        a, b = rule.split(" = ")
        out = out.replace(f" {b} ", f" {a} ")
    return out.strip()


def test_licences_against_a_plain_scan(spark):
    from intervale.llm.licence_texts import KNOWN_TEXTS, full_texts
    from intervale.llm.licences import known_digests, scan

    rng = random.Random(14)
    known, rows = KNOWN_TEXTS + full_texts(), []
    for i, (name, text) in enumerate(known):
        bent = re.sub(r"\bcopyright holder\b", "copyright  owner", re.sub(r"\blicense\b", "licence", text)) if i % 2 else text.title()
        rows += [(10 * i, bent), (10 * i + 1, f"Copyright (c) {1990 + i} A Person\n\n{bent}\n"), (10 * i + 2, bent + " extra"), (10 * i + 3, " ".join(w for w in bent.split() if rng.random() > 0.01) + " x")]
    want = {}
    for name, text in known:
        want.setdefault(canonical_plainly(text), name)
    got = {r.doc_id: r.licence for r in scan(documents(spark, rows)).collect()}
    assert got == {i: want.get(canonical_plainly(t)) for i, t in rows}
    assert sum(v is not None for v in got.values()) >= 2 * len(known)
    table = spark.createDataFrame([("L1", "Do as you like!"), ("L0", "do AS you, like"), (None, "x"), ("L2", "...")], "licence string, text string")
    assert [r.licence for r in scan(documents(spark, [(1, "DO AS YOU LIKE"), (2, "x"), (3, "")]), table).orderBy("doc_id").collect()] == ["L0", None, None]
    assert known_digests(spark, table).count() == 1


# ---------------------------------------------------------------- language model


def test_counts_beyond_32_bits_add_up():
    from intervale.llm import interpolated_lm as lm

    hashes = [np.array([3, 9], np.uint64), np.array([3], np.uint64), np.array([9, 2**63 + 1], np.uint64)]
    counts = [np.array([[2**32 - 1, 5], [1, 2]], np.uint32), np.array([[2**32 - 1, 7]], np.uint32), np.array([[4, 0], [2**31, 1]], np.uint32)]
    sums, place = lm.summed(hashes, counts)
    assert sums[place].tolist() == [[2**33 - 2, 12], [5, 2], [2**33 - 2, 12], [5, 2], [2**31, 1]]
    assert (lm._unplanes(lm._planes(sums.ravel()), np.uint64) == sums.ravel()).all()


def lm_tokens(text):
    return [*folded(text).split(), "END"]


def test_language_model(spark, awkward, monkeypatch):
    from intervale.llm import interpolated_lm as lm

    rng = random.Random(9)
    rows = awkward + [(300 + i, prose(rng, 20 + i % 9) + f" rare{i}") for i in range(80)]
    fold = lambda i: {0: 0, 1: 2}.get(zlib.crc32(str("" if i is None else i).encode()) % 10, 1)
    from intervale.llm.runtime import id_remainder

    remainder = id_remainder(F.col("doc_id"), 10)
    got = lm.interpolated_scores(documents(spark, rows, CLASHING), remainder=remainder).collect()
    counts, pairs, contexts = collections.Counter(), collections.Counter(), collections.Counter()
    main = [collections.Counter() for _ in range(3)]
    held = collections.Counter()
    for i, t in rows:
        f, tokens = fold(i), lm_tokens(t)
        for a, b in zip(["END", *tokens], tokens):
            if f:
                counts[b] += 1
                pairs[a, b] += 1
                contexts[a] += 1
            if f == 1:
                main[0][b] += 1
                main[1][a, b] += 1
            if f == 2:
                held[a, b] += 1
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {n}
    by_key = collections.defaultdict(list)
    for r in got:
        by_key[r.doc_id, r.n_tokens].append(r)
    model = lm.InterpolatedModel(documents(spark, rows), F.when(remainder == 0, 0).when(remainder == 1, 2).otherwise(1))
    assert (np.abs(model.weights.sum(axis=1) - 1) < 1e-9).all() and (model.weights[:, 2] > 0).all() and model.weights[0, 0] == 0
    scores = []
    for i, t in rows:
        tokens = lm_tokens(t)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        score = 0.0
        for a, b in zip(["END", *tokens], tokens):
            w = model.weights[int(lm.bucket_of(np.array([contexts[a]]))[0])]
            score += math.log10(w[0] * pairs[a, b] / max(1, contexts[a]) + w[1] * counts[b] / n + w[2] / (v + 1))
        row = min(by_key[i, len(tokens)], key=lambda r: abs(r.base_score - base))
        assert row.held_out == (fold(i) == 0) and row.n_known == sum(counts[w] > 0 for w in tokens)
        assert abs(row.base_score - base) < 1e-6 and abs(row.score - score) < 1e-6
        scores.append((base, score))
    assert lm.interpolated_scores(documents(spark, []), remainder=remainder).count() == 0
    none = lm.interpolated_scores(documents(spark, [(0, "a b")]), remainder=F.lit(0)).first()
    assert (none.train_tokens, none.n_known, none.base_score, none.score) == (0, 0, 0.0, 0.0)


def test_weights_raise_the_likelihood():
    from intervale.llm.interpolated_lm import learn_weights

    rng = np.random.default_rng(1)
    pair, word, n = rng.random(200) * (rng.random(200) > 0.3), rng.random(200) / 10, rng.integers(1, 9, 200).astype(float)
    bucket = rng.integers(0, 4, 200)
    w = learn_weights(bucket, np.where(bucket == 0, 0, pair), word, 1e-3, n)
    for b in range(1, 4):
        rows = bucket == b
        likelihood = lambda x: (n[rows] * np.log(x[0] * pair[rows] + x[1] * word[rows] + x[2] * 1e-3)).sum()
        for other in ([1 / 3] * 3, [0.9, 0.05, 0.05], [0.05, 0.9, 0.05]):
            assert likelihood(w[b]) >= likelihood(other) - 1e-3


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, awkward, tmp_path):
    import corpus_pipeline
    from intervale.llm.sentencepiece_unigram import Codec, load

    rng = random.Random(12)
    rows = awkward + [(400 + i, prose(rng, 40 + i)) for i in range(20)]
    documents(spark, rows, CLASHING).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lettered = [(k, i, t) for k, (i, t) in enumerate(rows) if t and any(c.isalpha() for c in t)]
    exact = {}
    for k, i, t in lettered:
        best = exact.get(folded(t))
        if best is None or (i is not None and (best[1] is None or i > best[1])):
            exact[folded(t)] = (k, i, t)
    left = list(exact.values())
    marks = similar_plainly([t for _, _, t in left])
    groups = collections.defaultdict(list)
    for m, x in zip(marks, left):
        groups[m].append(x)
    want = {min(g, key=lambda x: (x[1] is None, x[1]))[2] for g in groups.values()}
    codec = Codec(load(public_tokenizers.path("piece_bpe_32k.model")))
    assert {codec.decode(r.ids) for r in got} == want
    assert len(corpus_pipeline.STAGES) == 5
    none = tmp_path / "none"
    documents(spark, []).write.parquet(str(none / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(none)).count() == 0


def test_stages_one_by_one(spark, awkward):
    import corpus_pipeline

    docs = documents(spark, awkward, CLASHING)
    found = corpus_pipeline.language_id(spark, docs, "")
    assert found.columns == docs.columns and {r.doc_id for r in found.collect()} == {i for i, t in awkward if t and any(c.isalpha() for c in t)}
    assert {r.lang for r in found.collect()} <= {"en", "de"}
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns and mixed.count() >= docs.count() and mixed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    coded = corpus_pipeline.pieces(spark, docs, "").collect()
    assert len(coded) == len(awkward) and all((len(r.ids) == 0) == (r.doc_id is None or r.doc_id in (5, 6)) for r in coded if r.doc_id is not None)
    for stage in (corpus_pipeline.exact_dedup, corpus_pipeline.near_dedup):
        kept = stage(spark, docs, "")
        assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_pairs_of_each_similarity(spark):
    rng = random.Random(36)
    rows = []
    for level, cut in enumerate((5, 11, 16, 20, 21, 24, 40)):  # Jaccard 0.95 to 0.66 of 196 shingles
        for k in range(25):
            words = fresh(rng, 200)
            rows += [(1000 * level + 2 * k, " ".join(words)), (1000 * level + 2 * k + 1, " ".join(words[: 200 - cut] + fresh(rng, cut)))]
    kept = kept_ids(spark, rows)
    assert kept == first_of_each(rows)
    assert sum(i % 2 for i in kept) == 25 * 2  # those below 0.8 all stay
