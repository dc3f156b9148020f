import base64
import random

import common
from hypothesis import given, settings
from hypothesis import strategies as st

from arraysail.llm import token_counts as K


def _reference():
    import tiktoken

    with open(K.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=ranks, special_tokens={})


REFERENCE = _reference()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abc \n\t'.!?12é漢  \x1c\x85"), st.characters(exclude_categories=("Cs",))), max_size=80))
def test_counts_match_a_public_tokenizer(text):
    assert K.counter().count(text) == len(REFERENCE.encode_ordinary(text))


def test_pieces_merge_like_the_plain_way():
    rng, c = random.Random(0), K.counter()

    def plain(b):
        parts = [b[i : i + 1] for i in range(len(b))]
        while True:
            pairs = [(c.ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in c.ranks]
            if not pairs:
                return len(parts)
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for _ in range(300):
        piece = "".join(rng.choice("abehinorst") for _ in range(rng.randrange(1, 30)))
        if piece.encode() not in c.ranks:
            assert c.count_piece(piece) == plain(piece.encode())


def test_query_over_the_table(spark):
    docs = common.table(spark, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in K.counts(docs).collect()}
    assert got == {i: len(REFERENCE.encode_ordinary(t)) for i, t in texts.items()}


def test_edges(spark, edge):
    rows = K.counts(edge).collect()
    assert len(rows) == edge.count()
    by = {r["doc_id"]: r["n_tokens"] for r in rows}
    assert by[100] == by[101] == 0 and by[102] > 0 and by[105] == len(REFERENCE.encode_ordinary("x" * 300_000))
    assert K.counts(common.empty(edge)).count() == 0
