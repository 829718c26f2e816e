import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from codicil.__main__ import CHUNKS, REGULATIONS, main, stores
from codicil.functions.vectors import HashingEmbedder
from codicil.operators.answers import ModelError
from codicil.operators.requests import SettingsError
from codicil.sources.models import HttpChat, HttpEmbedder, chat_models, embedder_of


class Service(BaseHTTPRequestHandler):
    """Embeds by words, writes one answer; the model "tired" refuses."""

    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.seen.append((self.path, body["model"], self.headers.get("Authorization")))
        if body["model"] == "tired":
            self.send_response(429)
            self.end_headers()
            self.wfile.write(b"too many requests")
            return
        self.send_response(200)
        self.end_headers()
        if self.path.endswith("/embeddings"):
            rows = [{"index": i, "embedding": v} for i, v in enumerate(HashingEmbedder(dimensions=16).embed(body["input"]))]
            self.wfile.write(json.dumps({"data": rows[::-1]}).encode())  # in any order
            return
        for piece in ("El cupo es de ", "$ 1.500 [1].", ""):
            self.wfile.write(f"data: {json.dumps({'choices': [{'delta': {'content': piece}}]})}\n\n".encode())
        self.wfile.write(b": comment\n\ndata: [DONE]\n\n")

    def log_message(self, *_):
        pass


@pytest.fixture
def url():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Service.seen.clear()
    yield f"http://127.0.0.1:{server.server_port}/v1"
    server.shutdown()
    server.server_close()


def test_models_from_settings(url):
    assert isinstance(embedder_of({}, 16), HashingEmbedder)
    with pytest.raises(SettingsError, match="EMBEDDINGS_MODEL: missing"):
        embedder_of({"EMBEDDINGS_URL": url}, 16)
    e = embedder_of({"EMBEDDINGS_URL": url, "EMBEDDINGS_MODEL": "words", "EMBEDDINGS_KEY": "k"}, 16)
    assert e == HttpEmbedder(url, "words", 16, "k") and e.embed([]) == []
    assert e.embed(["uno", "dos"]) == HashingEmbedder(dimensions=16).embed(["uno", "dos"]) and Service.seen[-1] == ("/v1/embeddings", "words", "Bearer k")
    env = {"CHAT_URL": url, "CHAT_KEY": "k", "CHAT_MODELS": "tired, good", "LOCAL_CHAT_URL": url, "LOCAL_CHAT_MODELS": "own"}
    assert [(m.provider, m.model) for m in chat_models(env)] == [("hosted", "tired"), ("hosted", "good"), ("local", "own")] and not chat_models({})
    assert [m.provider for m in chat_models(env | {"CHAT_PROVIDERS": "local,hosted"})] == ["local", "hosted", "hosted"]
    assert list(HttpChat("p", "good", url).stream("i", "q")) == ["El cupo es de ", "$ 1.500 [1]."] and Service.seen[-1][2] is None
    with pytest.raises(ModelError, match="HTTP 429: too many") as failed:
        list(HttpChat("p", "tired", url).stream("i", "q"))
    assert failed.value.status == 429


def test_answer_command(spark, tmp_path, url, monkeypatch, capsys):
    regulations, _, chunks, _ = stores(spark, str(tmp_path))
    filled = lambda schema, **k: spark.createDataFrame([tuple(k.get(c.split()[0]) for c in schema.split(", "))], schema)
    regulations.append(filled(REGULATIONS, id=1, type="Ley", number="7", title="Pesca"))
    chunks.append(filled(CHUNKS, id=5, regulation_id=1, ordinal=0, section="article", content="El cupo de captura es de $ 1.500 por buque"))
    ask = ["answer", "--store", str(tmp_path), "--dimensions", "16", "--min-similarity", "0.1", "¿Cuál es el cupo de captura por buque?"]
    for name, value in {"EMBEDDINGS_URL": url, "EMBEDDINGS_MODEL": "words"}.items():
        monkeypatch.setenv(name, value)
    assert main(ask, spark) == 2
    for name, value in {"CHAT_URL": url, "CHAT_KEY": "k", "CHAT_MODELS": "tired,good"}.items():
        monkeypatch.setenv(name, value)
    assert main(["embed", "--store", str(tmp_path), "--dimensions", "16"], spark) == 0
    assert [r.embedding_model for r in chunks.read().collect()] == ["words"]
    capsys.readouterr()
    assert main(ask, spark) == 0
    events = [(b.split("\n")[0][7:], json.loads(b.split("\n")[1][6:])) for b in capsys.readouterr().out.strip().split("\n\n")]
    assert [k for k, _ in events] == ["sources", "asking", "skipped", "asking", "text", "text", "done"] or [k for k, _ in events] == ["sources", "asking", "skipped", "asking", "text", "done"]
    done = events[-1][1]
    assert done["outcome"] == "answered" and done["cited"] == [1] and done["model"] == "good" and events[2][1]["reason"] == "rate_limit"
    assert [(x["digits"], x["status"], x["cited"]) for x in done["amounts"]] == [("1500", "supported", [1])]
    assert events[0][1]["sources"][0]["regulation_id"] == 1 and events[0][1]["language"] == "es"
    monkeypatch.setenv("CHAT_MODELS", "tired")
    assert main(ask, spark) == 1
