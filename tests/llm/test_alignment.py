"""Alignment of two tokenizers against the definition, text by text and link by link."""

import hashlib
import random
from collections import Counter

import public_tokenizers as public
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import alignment

ODD = [None, "", " ", "\n\t\x0b ", "x", "é ü 漢字 🙂", "a▁b", "<|endoftext|> <s> <unk></s> <0x41>", "\x00 \x01", "a  b   c\n\n d ",
       "word " * 3000, "a" * 20_000, " lead and trail "]


def byte_of():
    """The bytes behind the characters of a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain(texts):
    first = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    to_byte, out, count = byte_of(), [], Counter()
    for text in texts:
        links, groups = [], ""
        a = b = []
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            raw_a = [bytes(to_byte[c] for c in first.id_to_token(i)) for i in a]
            raw_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
                     for i in b]
            if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
                a = b = []
        if a:
            ends_a = [sum(map(len, raw_a[:k + 1])) for k in range(len(a))] if len(a) < 300 else None
            if ends_a is None:
                ends_a, at = [], 0
                for x in raw_a:
                    at += len(x)
                    ends_a.append(at)
            ends_b, at = [], 0
            for x in raw_b:
                at += len(x)
                ends_b.append(at)
            both = sorted(set(ends_a) & set(ends_b))
            of_a, of_b = dict(zip(ends_a, a)), dict(zip(ends_b, b))
            links = [(of_a[e], of_b[e]) for e in both]
            parts, low = [], 0
            for e in both:
                parts.append(",".join(str(i) for i, x in zip(a, ends_a) if low < x <= e) + "|"
                             + ",".join(str(i) for i, x in zip(b, ends_b) if low < x <= e))
                low = e
            groups = hashlib.sha256(";".join(parts).encode()).hexdigest()
        count.update(links)
        out.append((len(a), len(b), links, groups))
    top = {}
    for (x, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    return [(a, b, len(links), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), g)
            for a, b, links, g in out], count


@pytest.mark.parametrize("batch_tokens", [2_000_000, 50])
def test_report_follows_the_definition(spark, batch_tokens):
    rng = random.Random(13)
    bits = ["the", "The", " ", "  ", "ing", "é", "漢", "'s", "123", "\n", ".", "tokenizer", "🙂", "<s>", "straße", "▁"]
    texts = [rng.choice(["", " "]).join(rng.choice(bits[:15] if rng.random() < .9 else bits) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    texts += [texts[0]] * 80 + ODD
    want, _ = plain(texts)
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, sha string").repartition(3)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = {r.doc_id: tuple(r[n] for n in names) for r in alignment.report(df, batch_tokens).collect()}
    assert got == dict(enumerate(want)) and sum(w[0] == 0 for w in want) >= 3


def test_counts_of_pairs_repeated_rows_and_empty_tables(spark):
    texts = ["one two", "one two", "two", None, ""]
    _, count = plain(texts)
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    table = alignment.pair_counts(alignment.aligned_texts(df)).collect()
    assert {(r.a, r.b): r.n for r in table} == dict(count)
    rows = alignment.report(df).collect()
    assert len(rows) == 5 and sorted(r.n_a for r in rows) == [0, 0, 1, 2, 2]
    assert alignment.report(df.limit(0)).count() == 0 and alignment.report(df.where("text = ''")).first().groups_sha256 == ""
