"""Ids, spans and decoded texts against the sentencepiece library, with the given model and with compiled character maps."""

import hashlib
import random

import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from caselight.llm import pieces, queries

with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
    MODEL = file.read()
ODD = ["", "  a b\x00\n é▁x 🀀", None, " ", "▁", "▁▁ ▁", "a🀀🀀b  ", "\n\n\t x", "<0x0A></s><s>", "日本語テキスト", "ﬁ ①　x ", "word " * 30_000]


def texts(n):
    r = random.Random(n)
    return ODD + ["".join(r.choice("ab  ▁é🀀日\n\t.ﬁ①Ǻ　 ") for _ in range(r.randint(0, 30))) for _ in range(n)]


def changed(rule, extra, dummy):
    """The model with another compiled map."""
    proto = sentencepiece_model_pb2.ModelProto.FromString(MODEL)
    other = sentencepiece_model_pb2.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = other.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.add_dummy_prefix = extra, dummy
    return proto.SerializeToString()


@pytest.mark.parametrize("model", [MODEL, *[changed(r, e, d) for r in ("nmt_nfkc", "nfkc_cf") for e in (False, True) for d in (False, True)]])
def test_ids_and_spans_are_the_library_s(model):
    library, data = sentencepiece.SentencePieceProcessor(model_proto=model), texts(600)
    offsets, ids, begins, ends = pieces.Encoder(model).encode(pa.array(data, pa.string()))
    for k, text in enumerate(data):
        own = slice(offsets[k], offsets[k + 1] - 1)
        want = [(p.id, p.begin, p.end) for p in library.encode(text or "", return_type="proto").pieces]
        assert list(zip(ids[own].tolist(), begins[own].tolist(), ends[own].tolist(), strict=True)) == want, text
        assert ids[offsets[k + 1] - 1] == library.eos_id()


def test_malformed_bytes_are_replaced_as_in_the_library():
    data = [b"a\xe2\x96 \xffb", b"\x80", b"\xf0\x9f\x80", b"\xed\xa0\x80x"]
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    offsets, ids, begins, ends = pieces.Encoder(MODEL).encode(pa.array(data, pa.binary()))
    for k, text in enumerate(data):
        own = slice(offsets[k], offsets[k + 1] - 1)
        assert list(zip(ids[own].tolist(), begins[own].tolist(), ends[own].tolist(), strict=True)) == [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]


def test_rows_of_any_kind_and_the_digest(spark):
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    data = [(k if k % 7 else None, t, k) for k, t in enumerate(texts(100))]
    data.append(data[5])
    docs = spark.createDataFrame(data, "doc_id long, text string, ids long").repartition(3)
    coded = pieces.encode(docs, MODEL)
    assert coded.columns == ["doc_id", "ids", "begins", "ends", "decoded"] and coded.count() == len(data)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digest(coded).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text, _ in data:
        ids = library.encode(text or "", add_eos=True)
        want.append((doc_id is None, doc_id or 0, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(want)
    again = pieces.decode(coded.withColumnRenamed("decoded", "was"), MODEL)
    assert again.where("was != decoded").count() == 0 and again.count() == len(data)
    assert pieces.digest(pieces.encode(docs.limit(0), MODEL)).collect() == []


def test_the_query_over_the_given_documents(spark):
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in queries.op11_sentencepiece(spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_eos=True)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
