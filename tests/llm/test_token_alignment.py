import random
from collections import Counter

import pytest

from vistaframe.llm import queries, token_alignment
from vistaframe.llm.token_alignment import aligned, with_link_counts

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def encoders():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    codes = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in codes} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in codes)}

    def encode(text):
        x, y = a.encode(" " + text, add_special_tokens=False), b.encode(text)
        xs = [bytes(byte[c] for c in t) for t in x.tokens]
        ys = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(y, b.id_to_piece(y))]
        return list(zip(x.ids, xs)), list(zip(y, ys))

    return encode


def ends(tokens):
    out, at = [], 0
    for i, b in tokens:
        at += len(b)
        out.append((at, i))
    return out


def brute(texts, encode, together=True):
    docs, counts = [], Counter()
    for t in texts:
        x, y = encode(t) if t else ([], [])
        if b"".join(b for _, b in x) != (" " + (t or "")).encode() or b"".join(b for _, b in y) != (" " + (t or "")).encode():
            docs.append((0, 0, "", []))
            continue
        x, y = ends(x), ends(y)
        cuts = sorted({e for e, _ in x} & {e for e, _ in y})
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for e, i in x if low < e <= c) + "|" + ",".join(str(i) for e, i in y if low < e <= c))
            low = c
        start = lambda z: [0, *(e for e, _ in z)]
        links = [(i, j) for (e, i), s in zip(x, start(x)) for (f, j), r in zip(y, start(y)) if (e == f if together else s < f and r < e)]
        counts.update(links)
        docs.append((len(x), len(y), ";".join(groups), links))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [(a, b, g, len(li), sum(counts[p] == best[p[1]] for p in li), sum(counts[p] for p in li)) for a, b, g, li in docs]


def texts_of(seed, n):
    r = random.Random(seed)
    words = ["the", "mountain", "Bergführer", "été", "naïve", "don't", "x=1;", "12345", "日本語", "\U0001f600", "<s>", "<|endoftext|>", "▁", "a b", " ", "\x85", "\t", "\n", "", "  ", "क़", "é", "Ω", "'s", "'", "-", "\x00", "ﬁ"]
    texts = [None, "", " ", "  ", " a", "a ", "a  b", "a b", "\n a", "<unk> b", "日本" * 300, "word" * 5000, "un" + "known " * 40]
    return texts + ["".join(r.choice(words) + r.choice([" ", " ", " ", "", "\n"]) for _ in range(r.randrange(1, 14))) for _ in range(n)]


@pytest.mark.parametrize("together", [True, False])
def test_equals_brute_force(spark, encoders, together):
    texts = texts_of(4, 250)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in with_link_counts(aligned(docs, A, B, together)).collect()}
    want = brute(texts, encoders, together)
    assert sum(w[0] == 0 for w in want) > 4
    for i, w in enumerate(want):
        g = got[i]
        assert (g.n_a, g.n_b, g.groups, g.n_links, g.n_best, g.count_sum) == w, texts[i]
        assert g.n_groups == (len(w[2].split(";")) if w[2] else 0)


def test_passes_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts_of(9, 120))), "doc_id long, text string")
    want = sorted(with_link_counts(aligned(docs, A, B)).collect())
    monkeypatch.setattr(token_alignment, "PASS_PAIRS", 50)
    assert sorted(with_link_counts(aligned(docs, A, B)).collect()) == want


def test_a_full_memory_changes_nothing(encoders, monkeypatch):
    from pathlib import Path

    monkeypatch.setattr(token_alignment, "REMEMBERED", 20)
    monkeypatch.setattr(token_alignment, "PIECE_CHARS", 4)
    aligner = token_alignment.Aligner(Path(A).read_text(), Path(B).read_bytes())
    texts = texts_of(2, 60)
    for _ in range(2):
        assert [x[3] if x else "" for x in aligner.texts(texts)] == [w[2] for w in brute(texts, encoders)]
    assert len(aligner.known) == 20


def test_empty_table_and_other_columns(spark, tmp_path):
    docs = spark.createDataFrame([(None, "one two", 0.5, "x"), (None, "one two", 0.5, "x")], "doc_id long, text string, weight double, groups string")
    assert with_link_counts(aligned(docs.where("false"), A, B)).collect() == []
    got = with_link_counts(aligned(docs, A, B)).collect()
    assert [(r.doc_id, r.weight, r.n_links, r.count_sum) for r in got] == [(None, 0.5, 2, 4)] * 2
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op12_token_alignment(spark, str(tmp_path)).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
