import base64
import gzip
import hashlib
import inspect
import random
import re
import sys
import time
import tracemalloc
import zlib
from urllib.parse import quote

from hypothesis import given, settings
from hypothesis import strategies as st

from panelwright.llm.queries import op8_secret_scan
from panelwright.llm.secrets import scan_secrets, unwrap

SECRET = "password=hunter2hunter2"


def plain(text):
    """The base rule of the contract, written out."""
    out = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(out)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "Secret", "api_key", ":", "=", " ", '"', "AKIA", "ABCD1234" * 3, "deadbeef" * 4, "x", "é", "ſecret", "%3D", "\\u003d", "\n"])).map("".join))
def test_base_spans_match_the_written_rule(text):
    assert [s[:3] for s in unwrap(text) if s[3] == ""] == plain(text)


def test_nested_layers_map_to_the_document():
    packed = base64.b64encode(gzip.compress(SECRET.encode())).decode()
    twice = base64.b64encode(f"see {packed}".encode()).decode()
    text = f"é {quote(SECRET, safe='')} and {twice} end"
    got = {(s[3], s[0]): text[s[1] : s[2]] for s in unwrap(text)}
    assert got["url.", "assign"] == quote(SECRET, safe="")
    assert got["base64.base64.zip.", "assign"] == twice
    uni = "".join(f"\\u{ord(c):04x}" for c in SECRET)
    assert [(s[3], s[1], s[2]) for s in unwrap("a " + uni)] == [("unicode.", 2, 2 + len(uni))]


def _deflate(data):
    packer = zlib.compressobj(wbits=-15)
    return packer.compress(data) + packer.flush()


LAYERS = {
    "url": lambda t: quote(t, safe=""),
    "url all": lambda t: "".join(f"%{b:02x}" for b in t.encode()),
    "unicode": lambda t: "".join(f"\\u{ord(c):04X}" for c in t),
    "hex escapes": lambda t: "".join(f"\\x{b:02x}" for b in t.encode()),
    "base64": lambda t: base64.b64encode(t.encode()).decode(),
    "url-safe base64": lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("="),
    "mime": lambda t: base64.encodebytes(t.encode()).decode().rstrip(),
    "gzip": lambda t: base64.b64encode(gzip.compress(t.encode())).decode(),
    "two members": lambda t: base64.b64encode(gzip.compress(b"first\n") + gzip.compress(t.encode())).decode(),
    "zlib": lambda t: base64.b64encode(zlib.compress(t.encode())).decode(),
    "zlib in zlib": lambda t: base64.b64encode(zlib.compress(zlib.compress(t.encode()))).decode(),
    "deflate": lambda t: base64.b64encode(_deflate(t.encode())).decode(),
    "utf-16": lambda t: base64.b64encode(t.encode("utf-16")).decode(),
    "utf-16 without mark": lambda t: base64.b64encode(t.encode("utf-16-be")).decode(),
    "url gzip": lambda t: quote(gzip.compress(t.encode()), safe=""),
}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(list(LAYERS)), min_size=1, max_size=4), st.sampled_from(["", "é\x07 ", "id: "]))
def test_any_nest_is_unwrapped(names, before):
    wrapped = SECRET
    for name in names:
        wrapped = LAYERS[name](wrapped)
    text = f"{before}<{wrapped}> after"
    spans = [(s[1], s[2]) for s in unwrap(text) if s[0] == "assign" and s[4] == SECRET]
    assert any(len(before) < a + 4 and b <= len(before) + 1 + len(wrapped) for a, b in spans), names


def test_all_secrets_of_a_run_are_found():
    outer = "password=first1first1 password=second2second2 " + base64.b64encode(b"token=third3third3").decode()
    got = [(s[3], s[4]) for s in unwrap(base64.b64encode(outer.encode()).decode())]
    assert got == [("base64.", "password=first1first1"), ("base64.", "password=second2second2"), ("base64.base64.", "token=third3third3")]


def secrets(text, **options):
    return {s[4] for s in unwrap(text, **options)}


def test_base64_wrapped_shifted_and_with_odd_characters():
    long = "some words to begin with " * 3 + SECRET + " and more words" * 8
    wrapped = base64.encodebytes(long.encode()).decode()
    packed = base64.encodebytes(gzip.compress(random.Random(1).randbytes(300).hex()[:500].encode() + b" " + SECRET.encode())).decode()
    for text in (wrapped, wrapped.replace("\n", "\r\n"), "body:\n" + packed):
        assert SECRET in secrets(text)
    plain, zipped = base64.b64encode(b"see " + SECRET.encode() + b" there").decode(), base64.b64encode(gzip.compress(SECRET.encode())).decode()
    for before in ("com/a/", "key_", "x-", "abc/de/"):
        assert SECRET in secrets(before + plain) and SECRET in secrets(before + zipped)
    for odd in "\u00a0\ufeff\u3000\u200b\x1b\0":
        assert SECRET in secrets(base64.b64encode(f"{odd} {SECRET}".encode()).decode())


def test_compressed_layers_are_read_whole():
    filler = "é, " * 400_000
    for data in (filler + SECRET, SECRET + " " + filler):
        assert SECRET in secrets(base64.b64encode(gzip.compress(data.encode())).decode(), limit=10_001)
    members = base64.b64encode(gzip.compress(b"first, ") + gzip.compress(SECRET.encode())).decode()
    twice = base64.b64encode(gzip.compress(gzip.compress((filler + SECRET).encode(), 0))).decode()
    assert SECRET in secrets(members) and SECRET in secrets(twice, limit=1000)


def took(text, want=frozenset()):
    began = time.perf_counter()
    assert want <= secrets(text)
    return time.perf_counter() - began


def test_random_base64_takes_linear_time():
    data = random.Random(2).randbytes(3_000_000)
    small, large = (took(base64.b64encode(data[:n] + b" " + SECRET.encode()).decode(), {SECRET}) for n in (750_000, 3_000_000))
    assert large < 8 and large < 8 * small + 0.5
    assert took("%" * 300_000 + "x%9C" * 20_000) < 8


def nest(n, pack):
    data = SECRET.encode()
    for _ in range(n):
        data = pack(data)
    return data


def test_thousands_of_layers():
    """Nests are no calls in calls: they pass with few frames to spare."""
    zipped = base64.b64encode(nest(2000, lambda d: gzip.compress(d, 0, mtime=0))).decode()
    mixed = nest(150, lambda d: base64.b64encode(gzip.compress(d, mtime=0))).decode()  # each layer is 1 % longer: this is 20 KB
    limit = sys.getrecursionlimit()
    depth = len(inspect.stack(0))
    sys.setrecursionlimit(depth + 120)
    try:
        assert SECRET in secrets(zipped) and SECRET in secrets(mixed) and SECRET in secrets(nest(30, base64.b64encode).decode())
    finally:
        sys.setrecursionlimit(limit)


def test_memory_of_a_long_text_follows_its_length():
    text = "plain words " * 400_000 + SECRET
    tracemalloc.start()
    assert SECRET in secrets(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(text)


def test_cycles_and_bombs_end():
    assert unwrap("%25" * 2000 + "41") == []
    bomb = base64.b64encode(gzip.compress(b"z" * 5_000_000)).decode()
    assert unwrap(bomb, limit=1000) == []


def test_edge_rows(spark, tmp_path):
    rows = [(1, None), (None, ""), (2, SECRET), (2, SECRET), (3, "word " * 50_000 + SECRET)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    got = sorted((r.doc_id or 0, len(r.spans)) for r in scan_secrets(docs).collect())
    assert got == [(0, 0), (1, 0), (2, 1), (2, 1), (3, 1)]
    assert scan_secrets(docs.limit(0)).collect() == []


def test_query_against_the_written_rule(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op8_secret_scan(spark, sf).collect():
        spans = plain(docs[r.doc_id] or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.n_hex == sum(s[0] == "hex" for s in spans) and set(text.split(",")) <= set(r.spans.split(","))
