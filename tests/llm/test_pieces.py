import common
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arraysail.llm import pieces as P


def _reference():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


REFERENCE = _reference()


def _ids(texts):
    ids, n = P.encoder().encode(texts)
    ends = np.cumsum(n)
    return [ids[a - k : a].tolist() for a, k in zip(ends, n)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcdehinorst   \n\t.,é漢ü\x01"), st.characters(exclude_categories=("Cs",))), max_size=60), max_size=4))
def test_ids_match_a_public_tokenizer(texts):
    texts = [t for t in texts if "\x00" not in t]
    assert _ids(texts) == [REFERENCE.encode(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",), exclude_characters="▁"), max_size=60))
def test_round_trip_is_exact(text):
    assert P.encoder().model.decode(_ids([text])[0]) == text


def test_edges_are_all_occurrences_of_all_pieces():
    e = P.Encoder()
    text = "the▁there▁heat"
    codes = np.array([ord(c) for c in text] + [0], np.int64)
    start, piece = e.edges(codes)
    got = {(int(s), e.model.text[p]) for s, p in zip(start, piece)}
    assert got == {(i, t) for t in e.model.id for i in range(len(text)) if t and text.startswith(t, i)}


def test_query_over_the_table(spark):
    docs = common.table(spark, "documents")
    rows = P.encode(docs).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(rows) == len(texts) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)
    assert all(r["ids"] == REFERENCE.encode(texts[r["doc_id"]]) for r in rows)
    back = {r["doc_id"]: r["text"] for r in P.decode(P.encode(docs)).collect()}
    assert back == texts


def test_edge_cases(spark, edge):
    rows = P.encode(edge).collect()
    assert len(rows) == edge.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[100]["ids"] == by[101]["ids"] == [] and by[105]["round_trip"] and by[104]["round_trip"] and not by[106]["round_trip"]
    assert by[105]["ids"] == REFERENCE.encode("x" * 300_000)
    assert P.encode(common.empty(edge)).count() == 0
    assert P.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect()[0]["text"] is None


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _with(field, settings):
    """The model file with one message replaced by its old content and ``settings``."""
    with open(P.MODEL, "rb") as f:
        raw = f.read()
    old = dict(P._fields(raw))[field]
    new = old + b"".join(_varint(k << 3) + _varint(v) for k, v in settings.items())
    head = _varint(field << 3 | 2)
    return raw.replace(head + _varint(len(old)) + old, head + _varint(len(new)) + new)


@pytest.mark.parametrize(("field", "settings", "what"), [(3, {4: 1}, "white space"), (3, {3: 0}, "space before"), (2, {3: 1}, "merge pairs"), (2, {24: 1}, "suffix"), (3, {5: 0}, "escaped")])
def test_models_that_would_be_read_wrongly_are_refused(tmp_path, field, settings, what):
    path = tmp_path / "m.model"
    path.write_bytes(_with(field, {}))
    P.Model(str(path))
    path.write_bytes(_with(field, settings))
    with pytest.raises(ValueError, match=what):
        P.Model(str(path))


def test_long_stretches_and_unknown_characters_match_a_public_tokenizer():
    import random

    rng = random.Random(8)
    long = "".join(rng.choice("etaoinshrdlu") for _ in range(5000))
    mixed = "".join(rng.choice("abcde漢字\U0001f600\U00010348\u0b83") for _ in range(3000))
    texts = [long, mixed, f"{long[:401]} {mixed} {long[7:900]}", "\U00010348" * 700, "ab\U00010348cd"]
    assert _ids(texts) == [REFERENCE.encode(t) for t in texts]
