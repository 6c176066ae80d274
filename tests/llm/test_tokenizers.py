"""Token ids and counts against the libraries themselves, with chunks small enough to need many splices."""

import base64
import hashlib

import cases
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from promptmill.llm.bpe_codec import BytePairCoder
from promptmill.llm.queries import QUERIES
from promptmill.llm.token_counts import TokenCounter

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MODEL = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_bytes_of_chunked_texts(spark, encoding):
    rows = cases.awkward(words=("a", "don't", "'", "'re", "  ", "\n", " \n", "é", "汉字", "123", "!?", "\t\t"))
    coder = BytePairCoder(spark, RANKS, public_tokenizers.PATTERN, chunk=60, overlap=12)
    got = sorted((cases.key(r.doc_id), list(r.ids), bytes(r.decoded)) for r in coder.decode(coder.encode(cases.frame(spark, rows))).collect())
    assert got == sorted((cases.key(i), encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert coder.decode(coder.encode(cases.frame(spark, rows).limit(0))).count() == 0


def test_counts_of_chunked_texts(spark):
    whole = Tokenizer.from_file(MODEL)
    rows = cases.awkward(words=("a", "don't", "'s", "  ", "\n", "é", "汉字", "123", "!?", "<|endoftext|>", "Å"))
    counter = TokenCounter(spark, MODEL, chunk=60, overlap=12)
    got = sorted((cases.key(r.doc_id), r.n_bytes, r.n_tokens) for r in counter.count(cases.frame(spark, rows)).collect())
    assert got == sorted((cases.key(i), len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False))) for i, t in rows)
    assert counter.count(cases.frame(spark, rows).limit(0)).count() == 0


def test_byte_bpe_query(spark, folder, documents, encoding):
    def digest(data):
        return hashlib.sha256(data).hexdigest()
    got = sorted(tuple(r) for r in QUERIES["op9_byte_bpe"](spark, folder).collect())
    ids = {i: encoding.encode_ordinary(t or "") for i, t in documents}
    assert got == sorted((i, len(ids[i]), digest(" ".join(map(str, ids[i])).encode()), digest((t or "").encode())) for i, t in documents)


def test_token_count_query(spark, folder, documents):
    whole = Tokenizer.from_file(MODEL)
    got = sorted(tuple(r) for r in QUERIES["op10_token_counts"](spark, folder).collect())
    n = {i: len(whole.encode(t or "", add_special_tokens=False)) for i, t in documents}
    assert got == sorted((i, len((t or "").encode()), n[i], n[i] > 2048) for i, t in documents)
