"""Pages before a limit stay, and what lies after it is told."""

import json
from datetime import datetime

from feedloom.sources import fetch

NOW = datetime(2026, 1, 1)


def test_pages_before_a_limit_stay():
    tribe = {"url": "https://x.org/p", "kind": "tribe"}
    n = iter(range(100))
    rows = fetch.fetch_one(tribe, NOW, lambda u: (200, json.dumps({"next_rest_url": f"https://X.org/p?page={next(n)}"}).encode()))
    assert [r[4] for r in rows] == ["more than 20 pages"] + [None] * 20 and all(r[3] for r in rows[1:])
    rows = fetch.fetch_one(tribe, NOW, lambda u: (200, b'{"next_rest_url": "https://y.org/"}'))
    assert [r[4] for r in rows] == ["next page is on another site", None]
    rows = fetch.fetch_one(tribe, NOW, lambda u: (200, b'{"next_rest_url": "https://[y/"}'))
    assert rows[0][4] and rows[0][3] is None and len(rows) == 2


def test_links_after_the_limit_are_told():
    home = "".join(f'<a href="/events/details/{i}/">' for i in range(23))
    rows = fetch.fetch_one({"url": "https://x.org/c/", "kind": "bevy"}, NOW, lambda u: (200, home.encode()), lambda s: None)
    assert [r[4] for r in rows] == ["23 event links, more than 20"] + [None] * 20
