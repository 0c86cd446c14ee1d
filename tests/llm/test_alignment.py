"""Aligned tokens against brute force over the two tokenizer libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from plumbline.llm import alignment

DOCS = "doc_id long, text string, lang string, row long, pairs string, n_a int"
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "\n a \n\n b", "a b 　 c", "x\x1c y", "<|endoftext|> and <s> </s> <0x41>", "▁ a▁b ▁", "▁", "日本語のテキスト 漢字", "été", "👩‍👩‍👧 ok",
       "tab\tand\x0bvt\x0c", "1234567890 12,5", "don't we'll I'M", "\x00 nul\x00", "ａｂｃ ﬁ", "İstanbul ﻿ bom", "a" * 700, "zq" * 400 + " " + "ñandú " * 30, "the cat sat. " * 40, "\r\n \r\n", "....!!! ---", "    \u0085 x",
       "\U00010EE7 1a\U00010EE7a1", "퟿ �"]


def brute(rows):
    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    level = {chr(x): x for x in plain}
    level.update((chr(256 + n), x) for n, x in enumerate(x for x in range(256) if x not in plain))
    spell_a = lambda i: bytes(level[c] for c in a.id_to_token(i))
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, count = [], Counter()
    for name, text in rows:
        groups = []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            if b"".join(map(spell_a, ids_a)) == b"".join(map(spell_b, ids_b)) == (" " + text).encode():
                i = j = 0
                while i < len(ids_a):
                    left, right, x, y = [ids_a[i]], [ids_b[j]], len(spell_a(ids_a[i])), len(spell_b(ids_b[j]))
                    while x != y:
                        if x < y:
                            left.append(ids_a[i + len(left)])
                            x += len(spell_a(left[-1]))
                        else:
                            right.append(ids_b[j + len(right)])
                            y += len(spell_b(right[-1]))
                    groups.append((left, right))
                    i, j = i + len(left), j + len(right)
        links = Counter((x, y) for left, right in groups for x in left for y in right)
        count.update(links.keys())
        found.append((name, groups, links))
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for name, groups, links in found:
        text = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        out.append((name, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), links.total(), sum(n for p, n in links.items() if count[p] == best[p[0]]),
                    sum(n * count[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "x", 2) for i, t in rows], DOCS)


def test_parts_join_to_the_text():
    for text in ODD:
        assert " ".join(alignment.parts(text)) == text
    assert alignment.parts("a  b c") == ["a", " b", "c"] and alignment.parts(" a\n b ") == [" a\n b", ""]


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(4)
    letters = "abcdefgh  .,'\n\t 　​́é日本▁👩1290<|>\x1c\x85"
    out = [(n, t) for n, t in enumerate(ODD)] + [(n, "".join(draw.choice(letters) for _ in range(draw.randrange(1, 120)))) for n in range(100, 500)]
    out += [(n, "".join(chr(draw.choice((draw.randrange(1, 0x500), draw.randrange(0x2000, 0x3100), draw.randrange(0x1F000, 0x1FA00), 32))) for _ in range(60))) for n in range(500, 700)]
    out += [(r.doc_id + 1000, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    return out + [(3, "the cat sat. "), (3, "the cat sat. "), (None, "the cat"), (None, None), (9, None)]


def test_alignment(spark, rows):
    want = brute(rows)
    assert sum(r[1] == 0 for r in want) > 3 and sum(r[1] > 0 for r in want) > 500
    for broadcast in (alignment.BROADCAST, 0):
        got = alignment.align(frame(spark, rows).repartition(3), broadcast=broadcast).collect()
        assert sorted(map(tuple, got), key=repr) == want


def test_alignment_in_small_pieces_and_with_counted_groups(rows):
    data = [t for _, t in rows]
    first, second = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    worker = alignment.aligner(open(first, encoding="utf-8").read(), open(second, "rb").read())
    assert not worker.tokens.whole
    whole = list(worker.rows(iter(data)))
    assert len(whole) == len(data)
    sizes = alignment.PIECE, alignment.WIDE, alignment.WORDS
    try:
        alignment.PIECE, alignment.WIDE, alignment.WORDS = 40, 2, 50
        assert list(worker.rows(iter(data))) == whole
    finally:
        alignment.PIECE, alignment.WIDE, alignment.WORDS = sizes


def test_no_documents(spark):
    assert alignment.align(frame(spark, [])).count() == 0
    assert [tuple(r) for r in alignment.align(frame(spark, [(1, None), (2, "")])).orderBy("doc_id").collect()] == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
