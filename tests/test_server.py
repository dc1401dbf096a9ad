"""The feed over HTTP."""

import http.client
import threading

import pytest

from feedloom.operators.feed_server import FEED, HEALTH, server, tag_of


@pytest.fixture
def ask(tmp_path):
    path = tmp_path / "events.json"
    path.write_bytes(b'{"events":[]}\n')
    s = server(path)
    threading.Thread(target=s.serve_forever, daemon=True).start()

    def send(method, url, **headers):
        c = http.client.HTTPConnection(*s.server_address, timeout=5)
        c.request(method, url, headers={k.replace("_", "-"): v for k, v in headers.items()})
        r = c.getresponse()
        out = r.status, dict(r.getheaders()), r.read()
        c.close()
        return out

    send.path = path
    yield send
    s.shutdown()
    s.server_close()


def test_feed_and_tags(ask):
    status, head, body = ask("GET", FEED)
    assert (status, body, head["ETag"], head["Access-Control-Allow-Origin"]) == (200, ask.path.read_bytes(), tag_of(body), "*")
    assert ask("HEAD", FEED)[0::2] == (200, b"")
    for sent in (head["ETag"], f'"x", W/{head["ETag"]}', "*"):
        assert ask("GET", FEED, If_None_Match=sent)[0::2] == (304, b"")
    assert ask("GET", FEED, If_None_Match='"x"')[0] == 200


def test_other_paths(ask):
    assert ask("OPTIONS", FEED)[0] == 204 and ask("GET", "/none")[0] == 404
    ask.path.unlink()
    status, _, body = ask("GET", FEED)
    assert status == 500 and b"events.json" not in body and ask("GET", HEALTH)[0] == 200
