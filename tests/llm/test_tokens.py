"""Packing, token counts and token files against the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("pointloom.llm")
import public_tokenizers
from tokenizers import Tokenizer

from pointloom.llm import packing, token_counts, token_store, vocab


@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_bpe():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def odd_texts(n=400):
    rng = random.Random(3)
    alphabet = list("aAbBeEtTnN sS\n\t '.,!-0123456789éÉßñΣσςİıﬁ€☃  ́\U0001f600中文한글") + ["<|endoftext|>", "<|startoftext|>", "'ll", "  ", "aaaa", "the "]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def expected(tokenizer, rows, end):
    return Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, end])) for i, t in rows)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_byte_ids_equal_the_library(byte_bpe, documents):
    texts = odd_texts() + [r.text for r in documents.limit(150).collect()]
    ours = vocab.byte_bpe()
    for text, e in zip(texts, byte_bpe.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ours.ids(text).tolist() == e.ids, text


def test_word_counts_equal_the_library(word_bpe, documents):
    texts = odd_texts() + [r.text for r in documents.limit(300).collect()]
    ours = token_counts.word_bpe(public_tokenizers.path("word_bpe_49k.json"))
    for text, e in zip(texts, word_bpe.encode_batch(texts, add_special_tokens=False), strict=True):
        words, special = ours.words(text)
        assert int(ours.count(words).sum() if words else 0) + special == len(e.ids), text


def test_long_words_equal_the_library(word_bpe):
    rng = random.Random(4)
    ours = token_counts.word_bpe(public_tokenizers.path("word_bpe_49k.json"))
    for alphabet in ("a", "aab", "abcdefghijklmnopqrstuvwxyz", "^#!", "éeßñatons", "中文한글字"):
        for n in (257, 300, 1_000, 200_000):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            words, _ = ours.words(text)
            ours.learn(words)
            assert sum(ours.known[w] for w in words) == len(word_bpe.encode(text, add_special_tokens=False).ids), (alphabet, n)
    ours.learn(["short"])
    assert max(map(len, ours.known)) <= token_counts.LONG


def check_packing(pieces, rows, tokenizer, sequence=2048):
    wanted = expected(tokenizer, rows, 1)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    ids_of = defaultdict(list)
    for (i, ids), n in wanted.items():
        ids_of[i] += [ids] * n
    for i, all_ids in ids_of.items():
        got = Counter((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in by_doc[i])
        if len(all_ids) == 1:
            ids, at = all_ids[0], 0
            for start, length, check, total in sorted(got):
                assert start == at and check == crc(ids[start : start + length]) and total == len(ids)
                at += length
            assert at == len(ids)
        assert sum(p.length for p in by_doc[i]) == sum(map(len, all_ids))
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= sequence
    return by_sequence


def test_packing_of_documents(documents, byte_bpe):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    sequences = check_packing(packing.pack(documents.repartition(8)).collect(), rows, byte_bpe)
    used = sum(p.length for ps in sequences.values() for p in ps)
    assert used / (2048 * len(sequences)) > 0.98


def test_packing_of_awkward_rows(docs, rows, none, byte_bpe):
    check_packing(packing.pack(docs).collect(), [r[:2] for r in rows], byte_bpe)
    small = packing.PackingConfig(sequence=64, open_windows=2, min_cut=4, with_ids=True)
    pieces = packing.pack(docs, small).collect()
    check_packing(pieces, [r[:2] for r in rows], byte_bpe, 64)
    assert all(zlib.crc32(p.ids) == p.ids_crc32 for p in pieces)
    assert packing.pack(none).collect() == []


def test_token_counts_of_awkward_rows(docs, rows, none, word_bpe):
    got = Counter(tuple(r) for r in token_counts.token_counts(docs).collect())
    want = Counter()
    for i, t, *_ in rows:
        n = len(word_bpe.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 2048] += 1
    assert got == want
    assert token_counts.token_counts(none).collect() == []


def check_store(got, rows, tokenizer):
    got = sorted(got, key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = Counter((i, len(x), crc(x)) for (i, x), n in expected(tokenizer, rows, 2).items() for _ in range(n))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want


def test_token_store(spark, documents, docs, rows, none, byte_bpe):
    folder, manifest = token_store.write_store(documents)
    check_store(token_store.read_store(folder, manifest).collect(), [(r.doc_id, r.text) for r in documents.collect()], byte_bpe)
    text = documents.where("doc_id = 77").first().text
    assert token_store.read_document(spark, folder, manifest, 77).tolist() == [*byte_bpe.encode(text, add_special_tokens=False).ids, 2]
    assert token_store.read_document(spark, folder, manifest, -5) is None
    check_store(token_store.read_store(*token_store.write_store(docs)).collect(), [r[:2] for r in rows], byte_bpe)
    assert token_store.read_store(*token_store.write_store(none)).collect() == []


def test_token_store_in_many_bounded_parts(spark, documents, byte_bpe):
    """Many tasks and pieces, a doc_id of a third of the rows, nulls and copies."""
    text = documents.select("doc_id", "text")
    table = text.unionByName(spark.range(500).selectExpr("cast(7 as long) as doc_id", "concat('row ', id) as text")).unionByName(spark.range(30).selectExpr("cast(null as long) as doc_id", "'same text' as text"))
    config = token_store.StoreConfig(task_bytes=100_000, part_bytes=20_000, window_chars=512, sample=300)
    folder, manifest = token_store.write_store(table, config)
    parts = manifest.collect()
    assert len({p.part for p in parts}) > 10 and len(parts) > 40 and max(p.bytes for p in parts) < 80_000
    check_store(token_store.read_store(folder, manifest).collect(), [(r.doc_id, r.text) for r in table.collect()], byte_bpe)
    few = token_store.StoreConfig(task_bytes=100_000, part_bytes=20_000, most_tasks=2)
    folder, manifest = token_store.write_store(table, few)
    assert {p.part for p in manifest.collect()} == {0, 1} and manifest.count() > 40
    check_store(token_store.read_store(folder, manifest).collect(), [(r.doc_id, r.text) for r in table.collect()], byte_bpe)


def test_token_store_tells_broken_files(spark, tmp_path):
    table = spark.createDataFrame([(k, f"text number {k}") for k in range(40)], "doc_id long, text string")
    folder, manifest = token_store.write_store(table)
    uri, path = manifest.first().uri, manifest.first().uri.removeprefix("file://")
    dictionary = token_store._dictionary(folder)
    with pytest.raises(ValueError, match="another dictionary"):
        token_store.Part(uri, dictionary + b"x")
    whole = open(path, "rb").read()
    for broken in (whole[:-1], whole[:-200] + bytes([whole[-200] ^ 1]) + whole[-199:]):
        (tmp_path / "part.ids").write_bytes(broken)
        with pytest.raises(ValueError, match="not whole"):
            token_store.Part(f"file://{tmp_path}/part.ids", dictionary)
    # A task that ran twice leaves a file that the manifest does not name.
    open(path.replace(".ids", "9.ids"), "wb").write(whole[:50])
    assert token_store.read_store(folder, manifest).count() == 40


def test_dictionary_reads_whole_texts(spark):
    """Windows behind any prefix can be chosen, and copies of a text count once."""
    tail = "x" * 30_000 + "".join(f" rare{k}word" for k in range(3_000))
    table = spark.createDataFrame([(k, tail) for k in range(50)], "doc_id long, text string")
    config = token_store.StoreConfig(sample=50, window_chars=1_000)
    got = token_store.train_dictionary(table, config, 50 * len(tail))
    behind = token_store._serial(vocab.byte_bpe().ids("word rare"), config)[:-2]  # none of it is near the beginning
    assert behind in got and token_store.train_dictionary(table.limit(1), config, len(tail)) == got


def code_points():
    return [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]


def test_every_code_point_in_counts(word_bpe):
    """Each code point alone, between letters and behind a digit, against the library."""
    bpe = token_counts.word_bpe(token_counts.default_path("word_bpe_49k.json"))
    for frame in ("{}", "x{}y 1{}"):
        texts = [frame.format(c, c) for c in code_points()]
        want = [len(e.ids) for e in word_bpe.encode_batch(texts, add_special_tokens=False)]
        for at in range(0, len(texts), 50_000):
            part = [bpe.words(t) for t in texts[at : at + 50_000]]
            bpe.learn({w for ws, _ in part for w in ws})
            got = [sum(bpe.known[w] for w in ws) + special for ws, special in part]
            odd = [hex(ord(code_points()[at + k])) for k, (a, b) in enumerate(zip(got, want[at : at + 50_000], strict=True)) if a != b]
            assert not odd, odd[:20]


def test_every_code_point_in_ids(byte_bpe):
    bpe = vocab.byte_bpe("byte_bpe_50k")
    for frame in ("{}", "x{}y 1{}"):
        texts = [frame.format(c, c) for c in code_points()]
        for at in range(0, len(texts), 100_000):
            part = texts[at : at + 100_000]
            odd = [hex(ord(code_points()[at + k])) for k, (t, e) in enumerate(zip(part, byte_bpe.encode_batch(part, add_special_tokens=False), strict=True)) if bpe.ids(t).tolist() != e.ids]
            assert not odd, odd[:20]


#: One or a few characters of each class that a pattern may cut by, of many scripts, and contractions in both cases.
CLASSES = [
    "a", "Z", "é", "é", "ß", "ſ", "İ", "ж", "Ω", "א", "ع", "क", "क्ष", "ไ", "中", "ひ", "ア", "한", "ა", "Ꭰ", "\U00010400", "\U00020000", "ª", "ʰ", "ǅ",
    "0", "٣", "५", "½", "Ⅷ", "²", "㊉", "_", "-", "'", "’", "\"", ".", "¿", "،", "।", "。", "$", "€", "+", "™", "☃", "\U0001f600", "\U0001f468\u200d\U0001f469", "\ufe0f", "\u0301", "\u200b", "\u00ad",
    " ", "  ", "\t", "\n", "\r\n", "\u00a0", "\u2003", "\u3000", "\u2028", "\x85", "\x00", "\x1c", "\ue000",
    "'s", "'S", "'t", "'re", "'RE", "'ve", "'m", "'ll", "'LL", "'d", "’s", "'ſ", "don't", "I'LL", "<|endoftext|>",
]


def mixed_texts():
    """All pairs of classes, alone and between letters and spaces, and random runs of them."""
    rng = random.Random(11)
    pairs = [frame.format(a, b) for a in CLASSES for b in CLASSES for frame in ("{}{}", "x {}{} y", "{0}{1}{0}{0}")]
    return pairs + ["".join(rng.choices(CLASSES, k=rng.randint(3, 30))) for _ in range(4_000)]


def test_pairs_of_scripts_and_contractions_in_ids(byte_bpe):
    texts, ours = mixed_texts(), vocab.byte_bpe()
    wrong = [t for t, e in zip(texts, byte_bpe.encode_batch(texts, add_special_tokens=False), strict=True) if ours.ids(t).tolist() != e.ids]
    assert wrong == []


def test_pairs_of_scripts_and_contractions_in_counts(word_bpe):
    texts, ours = mixed_texts(), token_counts.word_bpe(public_tokenizers.path("word_bpe_49k.json"))
    wrong = []
    for text, e in zip(texts, word_bpe.encode_batch(texts, add_special_tokens=False), strict=True):
        words, special = ours.words(text)
        if (int(ours.count(words).sum()) if words else 0) + special != len(e.ids):
            wrong.append(text)
    assert wrong == []
