"""Optional backends with stand-ins for their packages, unreadable files, and the state of the stream's table."""

import sys
import types
from types import SimpleNamespace

import pytest

from graphloom import api, session
from graphloom.backends import HostedEmbedder, HostedModel, LocalEmbedder
from graphloom.config import ModelSettings, SearchSettings, Settings
from graphloom.errors import AnalysisError, ConfigurationError, MissingBackend
from graphloom.operators import index, packs, parse
from graphloom.sources import baselines, files
from graphloom.streaming import index_stream


def package(monkeypatch, name, **contents):
    module = types.ModuleType(name)
    module.__dict__.update(contents)
    monkeypatch.setitem(sys.modules, name, module)


def test_hosted_model(monkeypatch):
    asked = {}

    def completion(**given):
        asked.update(given)
        return SimpleNamespace(choices=[SimpleNamespace(message=SimpleNamespace(content=answer))])

    package(monkeypatch, "litellm", completion=completion)
    model = api.create_model(Settings(llm=ModelSettings(model="some/model", timeout=7)))
    assert isinstance(model, HostedModel) and api.create_model(Settings()) is None
    answer = '{"summary": "fine"}'
    assert model.complete(system="s", user="u") == answer
    assert (asked["model"], asked["timeout"], asked["num_retries"]) == ("some/model", 7, 2)
    assert [m["content"] for m in asked["messages"]] == ["s", "u"]
    for answer in ("  ", None):
        with pytest.raises(AnalysisError, match="empty"):
            model.complete(system="s", user="u")
    monkeypatch.setitem(sys.modules, "litellm", None)
    with pytest.raises(MissingBackend, match="litellm"):
        model.complete(system="s", user="u")


def test_embedders(monkeypatch):
    class TextEmbedding:
        def __init__(self, model_name):
            assert model_name == "small"

        def embed(self, texts):
            return ([float(len(t)), 1] for t in texts)

    package(monkeypatch, "fastembed", TextEmbedding=TextEmbedding)
    local = api.create_embedder(Settings(semantic=SearchSettings(provider="fastembed", model="small")))
    assert isinstance(local, LocalEmbedder) and [list(v) for v in local.embed_texts(["ab", ""])] == [[2, 1], [0, 1]]
    package(monkeypatch, "litellm", embedding=lambda model, input, num_retries: SimpleNamespace(data=[{"embedding": [len(t), num_retries]} for t in input][:5]))
    hosted = api.create_embedder(Settings(semantic=SearchSettings(provider="api", model="m")))
    hosted.batch = 2
    assert [list(v) for v in hosted.embed_texts(["a", "bb", "ccc"])] == [[1, 2], [2, 2], [3, 2]]
    with pytest.raises(AnalysisError, match="5 vectors for 6"):
        HostedEmbedder("m").embed_texts(["x"] * 6)
    monkeypatch.setitem(sys.modules, "fastembed", None)
    with pytest.raises(MissingBackend, match="fastembed"):
        LocalEmbedder("small").embed_texts(["x"])


def test_index_of_an_embedder_of_texts(spark, tmp_path):
    source = "def aaa():\n    pass\n\n\ndef bbb():\n    pass\n"
    pieces = api.chunks.chunks(parse.parse_sources(spark.createDataFrame([("m.py", source)], "rel_path string, content string")))
    stats = index.build(pieces, str(tmp_path), _embedder())
    assert (stats.total, stats.embedded, stats.dimensions) == (3, 3, 2)
    found = index.find(spark, str(tmp_path), "bb", _embedder(), 1, 0.0).first()
    assert found.symbol == "m.bbb" and found.score > 0.7


def _embedder():
    """One whose class workers need not import."""
    import numpy as np

    e = type("E", (), {"model_name": "letters", "embed_texts": lambda self, texts: [np.array([t.count("a"), t.count("b")], float) for t in texts]})
    return e()


def test_unreadable_files_are_rows(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "gone.py").write_text("y = 1\n")
    rows = files.source_files(spark, tmp_path)
    (tmp_path / "gone.py").unlink()
    found = {r.rel_path: (r.loc, r.syntax_error) for r in parse.parse_sources(rows).collect()}
    assert found["a.py"] == (1, None) and found["gone.py"][0] == 0 and "FileNotFoundError" in found["gone.py"][1]


@pytest.mark.parametrize("reference, parts", [("r", ("r", None, None)), (" r/x @a/b.py:12", ("r/x", "a/b.py", 12)), ("r@c:d", ("r", "c:d", None)), ("r@c:1:2", ("r", "c:1", 2)), ("r@", ("r", None, None)), ("r@:3", ("r", ":3", None))])
def test_references(reference, parts):
    assert packs.parse_reference(reference) == parts


@pytest.mark.parametrize("reference", ["", "  ", "@a.py"])
def test_references_without_a_rule(reference):
    with pytest.raises(AnalysisError):
        packs.parse_reference(reference)


@pytest.mark.parametrize("text", ["[]", "3", "{", '{"version": 2, "findings": []}', '{"version": 1}', '{"version": 1, "findings": {}}', '{"version": 1, "findings": [3]}', '{"version": 1, "findings": [{"fingerprint": 4}]}', '{"version": 1, "findings": [{}]}'])
def test_broken_baselines(tmp_path, text):
    (tmp_path / "b.json").write_text(text)
    with pytest.raises(ConfigurationError):
        baselines.load(tmp_path / "b.json")


def test_stream_writes_touched_buckets_only(spark, tmp_path):
    target, merge = str(tmp_path / "t"), index_stream._merge(spark, str(tmp_path / "t"))
    state, row = {}, "chunk_id string, content_hash string, version int"
    for n, names in enumerate([range(300), [5], [5, 1000], [5]]):
        batch = [(str(k), f"h{n}-{k}", n) for k in names]
        state |= {i: (h, v) for i, h, v in batch}
        for _ in range(2):  # a batch that is run again changes nothing
            merge(spark.createDataFrame(batch, row), n)
        assert {r.chunk_id: (r.content_hash, r.version) for r in index_stream.current(spark, target).collect()} == state
    kept = index_stream.versions(spark, target)
    assert len(kept) > 50 and max(map(len, kept.values())) == 2 and sum(3 in v for v in kept.values()) == 1


def test_shared_folder_is_asked_for_on_a_cluster():
    conf, context = SimpleNamespace(get=lambda *_: None), SimpleNamespace(master="spark://x")
    with pytest.raises(ConfigurationError, match="spark.checkpoint.dir"):
        session.shared_dir(SimpleNamespace(conf=conf, sparkContext=context))
