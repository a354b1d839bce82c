from pyspark.sql import functions as F

from tarnsearch.functions.routing import hash_urls, human_bytes, jump_hash, shard_for
from tarnsearch.functions.urls import canonical, resolve

BASE = "https://example.com/docs/page.html"
CASES = {
    "other.html": "https://example.com/docs/other.html",
    "/root.html": "https://example.com/root.html",
    "../up.html": "https://example.com/up.html",
    "/docs/../docs/./x": "https://example.com/docs/x",
    "//other.org/x": "https://other.org/x",
    "page.html#part": "https://example.com/docs/page.html",
    "?a=1": "https://example.com/docs/page.html?a=1",
    "#part": None,
    "": None,
    "  ": None,
    "mailto:a@b.example": None,
    "ftp://example.com/x": None,
    "tel:+123": None,
    "https://EXAMPLE.com.:443/x": "https://example.com/x",
    "http://example.com:80": "http://example.com/",
    "http://example.com:8080/x": "http://example.com:8080/x",
    "/x?utm_source=a&utm_campaign=b": "https://example.com/x",
    "/x?page=2&gclid=1&q=a%20b&flag": "https://example.com/x?page=2&q=a+b&flag=",
    "/a\tb\nc": "https://example.com/abc",
    "/a/%2e%2E/b/.%2e/%2e/c": "https://example.com/c",
    "\\x\\y?q=\\z": "https://example.com/x/y?q=%5Cz",
    "https:\\\\example.com\\x": "https://example.com/x",
    "/x?%75tm_source=a&utm%5fterm=b&page=2": "https://example.com/x?page=2",
    "/x?q=%zz&p=1": "https://example.com/x?q=%25zz&p=1",
    "/{..}/x": "https://example.com/%7B..%7D/x",
    "/à b": "https://example.com/%C3%A0%20b",
}


def test_resolve(column):
    got = column(lambda c: resolve(F.lit(BASE), c), list(CASES))
    assert dict(zip(CASES, got)) == CASES
    assert column(lambda c: resolve(F.lit(BASE), c), [None]) == [None]


def test_canonical_is_idempotent(column):
    once = [u for u in CASES.values() if u]
    assert column(canonical, once) == once
    assert column(canonical, ["not a url", None]) == [None, None]


def test_jump_hash_moves_few_keys():
    keys = hash_urls([f"https://site{i % 50}.example/page/{i}" for i in range(20_000)])
    ten, eleven = jump_hash(keys, 10), jump_hash(keys, 11)
    moved = (ten != eleven).mean()
    assert 0.07 < moved < 0.12 and (eleven[ten != eleven] == 10).all()
    sizes = [(ten == b).sum() for b in range(10)]
    assert max(sizes) < 1.15 * min(sizes)
    assert jump_hash(keys[:3], 0).tolist() == [0, 0, 0] and jump_hash(keys[:3], 1).tolist() == [0, 0, 0]


def test_hash_is_fnv_with_finaliser():
    def plain(url):
        h = 0xCBF29CE484222325
        for b in url.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ h >> 33) * m % 2**64
        return h ^ h >> 33

    urls = ["", "a", "https://e.example/ñ", "x" * 300]
    assert hash_urls(urls).tolist() == [plain(u) for u in urls]


def test_shard_column(column):
    got = column(lambda c: shard_for(c, 4), ["https://a.example/", None])
    assert 0 <= got[0] < 4 and got[1] is None


def test_human_bytes():
    assert [human_bytes(n) for n in (0, 1023, 1024, 1536, 5 << 30, 3000 << 40)] == ["0 B", "1023 B", "1.0 KiB", "1.5 KiB", "5.0 GiB", "3000.0 TiB"]
