import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tracewright.sources import gateway, http

TABLE = json.dumps({"headers": [], "rows": [], "warnings": ["seen"]})


@pytest.fixture
def model():
    """A model that answers as its list says, and keeps what it was asked."""
    plan, asked = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((self.path, self.headers["authorization"], json.loads(self.rfile.read(int(self.headers["content-length"])))))
            what = plan.pop(0)
            if what == "slow":
                time.sleep(1.5)
                what = TABLE
            status, content = (what, "") if isinstance(what, int) else (200, what)
            body = b"x" * (http.MAX_RESPONSE + 1) if content == "huge" else json.dumps({"choices": [{"message": {"content": content}}]}).encode()
            self.send_response(status)
            if status == 302:
                self.send_header("location", "/elsewhere")
            self.send_header("content-length", str(len(body)))
            self.end_headers()
            try:
                self.wfile.write(body)
            except OSError:
                pass

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1", plan, asked
    server.shutdown()


def test_calls_and_second_attempts(model):
    url, plan, asked = model
    send = http.sender(url, "secret", lambda stage, request: [(b"\x89PNG", "image/png")], timeout=0.5, allowed=lambda u: True)
    ask = lambda: gateway.ask(lambda r, c: send("table", r, c), '{"fileName": "a"}', gateway.OUTPUTS["table"])
    plan += [TABLE]
    assert ask() == (TABLE, None)
    path, key, body = asked[0]
    assert path == "/v1/chat/completions" and key == "Bearer secret" and body["temperature"] == 0 and body["messages"][1]["content"][1]["image_url"]["url"].startswith("data:image/png;base64,")
    for first, calls, error in ((503, 2, None), (429, 2, None), ("no json", 2, None), ("huge", 2, None), ("slow", 2, None), (400, 1, "MODEL_UNAVAILABLE"), (302, 1, "MODEL_UNAVAILABLE")):
        plan[:], asked[:] = [first, TABLE], []
        assert ask()[1] == error and len(asked) == calls, first
    plan[:], asked[:] = ["{}", TABLE], []
    assert ask() == (TABLE, None) and asked[1][2]["messages"][1]["content"][-1]["text"] == gateway.CORRECTION


def test_only_known_addresses():
    with pytest.raises(ValueError, match="address"):
        http.sender("http://127.0.0.1:1/v1", "k")
    gone = http.sender("http://127.0.0.1:1/v1", "k", timeout=0.5, allowed=lambda u: True)
    with pytest.raises(gateway.ModelError) as e:
        gone("table", "{}", None)
    assert e.value.retryable
