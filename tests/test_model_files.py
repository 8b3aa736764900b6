import json

import numpy as np
import pytest

from quern import tools
from quern.operators import embed
from quern.sources.model_files import ModelFiles
from quern.streaming.refresh import Response

VOCAB = {t: i for i, t in enumerate(["[UNK]", "[CLS]", "[SEP]", "cat", "dog", "tree"])}
TABLE = np.random.default_rng(1).normal(size=(6, 8)).astype(np.float32)


def field(n, value):
    """A protocol buffer's field: a number, or bytes with their length."""

    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    return varint(n << 3) + varint(value) if isinstance(value, int) else varint(n << 3 | 2) + varint(len(value)) + value


def onnx_bytes():
    """A graph that looks token ids up in TABLE."""

    def value(name, kind, *dims):
        shape = b"".join(field(1, field(1, d) if isinstance(d, int) else field(2, d.encode())) for d in dims)
        return field(1, name.encode()) + field(2, field(1, field(1, kind) + field(2, shape)))

    node = field(1, b"table") + field(1, b"input_ids") + field(2, b"last_hidden_state") + field(4, b"Gather")
    table = field(1, TABLE.shape[0]) + field(1, TABLE.shape[1]) + field(2, 1) + field(8, b"table") + field(9, TABLE.tobytes())
    inputs = b"".join(field(11, value(n, 7, 1, "n")) for n in ("input_ids", "attention_mask", "token_type_ids"))
    graph = field(1, node) + field(2, b"g") + field(5, table) + inputs + field(12, value("last_hidden_state", 1, 1, "n", TABLE.shape[1]))
    return field(1, 8) + field(7, graph) + field(8, field(1, b"") + field(2, 13))


class Server:
    def __init__(self):
        self.files = {"model.onnx": onnx_bytes(), "tokenizer.json": json.dumps({"model": {"vocab": VOCAB}}).encode(), "tokenizer_config.json": b"{}"}
        self.calls = []

    def __call__(self, name, etag):
        self.calls.append(name)
        return Response(200, self.files[name]) if name in self.files else Response(404)


def test_only_missing_files_are_fetched(tmp_path):
    server = Server()
    files = ModelFiles(str(tmp_path / "m"), server)
    files.ensure()
    assert sorted(server.calls) == sorted(files.names) and files.missing() == []
    assert (tmp_path / "m" / "tokenizer.json").read_text() == json.dumps({"model": {"vocab": VOCAB}}, indent=2)
    (tmp_path / "m" / "model.onnx").unlink()
    files.ensure()
    assert server.calls[3:] == ["model.onnx"]
    files.renew()
    assert len(server.calls) == 7
    offline = ModelFiles(str(tmp_path / "none"), server, offline=True)
    for call in (offline.ensure, offline.renew):
        with pytest.raises(OSError):
            call()
    with pytest.raises(OSError):
        ModelFiles(str(tmp_path / "x"), server, names=("nothing",)).ensure()


def test_broken_files_are_fetched_anew_once(tmp_path):
    server, seen = Server(), []
    files = ModelFiles(str(tmp_path), server)
    files.ensure()

    def read(f):
        seen.append(1)
        if len(seen) < 2:
            raise ValueError("broken")
        return 7

    assert files.load(read) == 7 and len(server.calls) == 6
    files.offline = True
    with pytest.raises(ValueError):
        files.load(lambda f: (_ for _ in ()).throw(ValueError("broken")))
    assert len(server.calls) == 6 and files.missing() == []


def test_a_graph_embeds_and_heals_itself(spark, tmp_path):
    server = Server()
    docs = spark.createDataFrame([(0, "cat cat"), (1, "dog"), (2, "tree dog")], "ord int, content string")
    e = tools.Engine(spark, files=ModelFiles(str(tmp_path), server), offline=False)
    e.warm()
    e._store = embed.embed(docs, "content", e.vocab, e.model).cache()
    for r in e._store.collect():
        ids = [1, *(VOCAB[w] for w in r.content.split()), 2]
        v = TABLE[ids].mean(axis=0, dtype=np.float64).astype(np.float32).astype(np.float64)
        assert np.allclose(r.embedding, v / np.sqrt((v**2).sum()), atol=1e-6)
    sent = embed.embed(docs, "content", e.vocab, embed.onnx_model(str(tmp_path / "model.onnx"), spark))
    assert sorted(r.embedding for r in sent.collect()) == sorted(r.embedding for r in e._store.collect())
    assert e.search_docs("dog", 1).first().text == "dog" and len(server.calls) == 3
    (tmp_path / "model.onnx").write_bytes(b"broken")
    assert e.search_docs("dog", 1).first().text == "dog" and len(server.calls) == 6
