import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib

import pytest

from lakelens.llm import secrets
from tests.llm.conftest import ODD

SECRET = 'password = "abcdefgh12345678"'
PLAIN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def brute(text):
    s = [("assign", *m.span()) for m in PLAIN.finditer(text) if len(m[2]) >= 12]
    s += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    s += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(s, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def wrap(how, text):
    return {
        "url": lambda: urllib.parse.quote(text, safe=""),
        "unicode": lambda: "".join(f"\\u{ord(c):04x}" for c in text),
        "entity": lambda: "".join(f"&#{ord(c)};" for c in text),
        "base64": lambda: base64.b64encode(text.encode()).decode(),
        "gzip": lambda: base64.b64encode(gzip.compress(text.encode())).decode(),
        "zlib": lambda: base64.urlsafe_b64encode(zlib.compress(text.encode())).decode(),
        "bz2": lambda: base64.b64encode(bz2.compress(text.encode())).decode(),
    }[how]()


@pytest.mark.parametrize("layers", [["url"], ["unicode"], ["entity"], ["base64"], ["gzip"], ["zlib"], ["bz2"], ["url", "base64"], ["base64", "base64", "url"], ["zlib", "url", "base64", "unicode"]])
def test_layers_are_unwrapped_and_mapped(layers):
    hidden = SECRET
    for how in layers:
        hidden = wrap(how, hidden)
    text = "é before " + hidden + " after"
    base, every = secrets.find_secrets(text, True)
    mapped = [s for s in every if s[0] == "assign"]
    assert mapped, layers
    for _, a, z in mapped:
        assert 9 <= a < z <= 9 + len(hidden)


def test_one_layer_maps_exactly():
    url = wrap("url", SECRET)
    _, every = secrets.find_secrets("x " + url, True)
    assert ("assign", 2, 2 + len(url) - 3) in every  # the closing quote is no part of it


def test_failed_matches_consume():
    assert secrets.scan("token: secret: longvalue12345") == []
    assert secrets.scan("AKIA" + "A" * 13) == [] and secrets.scan("AKIA" + "A" * 14) == [("access", 0, 18)]


def test_cycles_and_junk_end():
    assert secrets.find_secrets("%25" * 2000, True)[1] == []
    assert secrets.find_secrets("A" * 5000 + "==" + "\\u0041" * 50, True)


def test_random_texts_match_brute_force():
    r = random.Random(5)
    bits = ["password", "TOKEN", "api_key", "ApiKey", "=", ": ", '"', "'", "AKIA", "ABCDEF123456789012", "0123456789abcdef", "a.b-c_d+e/f=ghij", " ", "\n", "é", "sſecret", "K"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
        assert secrets.scan(text) and sorted(secrets.scan(text)) == sorted(brute(text)) or not brute(text) and not secrets.scan(text)


def test_report(spark, make_docs):
    rows = [*ODD, (8, SECRET + " " + wrap("base64", SECRET), "a"), (9, "x" * 100 + " deadbeefdeadbeef0", "a")]
    got = {(r.doc_id, r.spans): r for r in secrets.report(make_docs(rows, extra=True)).collect()}
    assert len(rows) == secrets.report(make_docs(rows)).count()
    for (doc_id, _), r in got.items():
        texts = {t or "" for i, t, *_ in rows if i == doc_id}
        joined = {hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in brute(t)).encode()).hexdigest() for t in texts}
        assert r.base_sha256 in joined
    eight = next(r for (i, _), r in got.items() if i == 8)
    assert eight.n_assign == 1 and eight.spans.count("assign") == 2


def test_redaction(spark, make_docs):
    docs = make_docs([(1, f"keep {SECRET} this", "a"), (2, None, "a"), (3, "nothing", "a")], extra=True)
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text == 'keep [assign removed]" this' and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text is None and rows[3].text == "nothing"


def test_empty_table(spark, make_docs):
    assert secrets.report(make_docs([])).count() == 0 and secrets.redact(make_docs([])).count() == 0


def spans_of(text, kind="assign"):
    return [s for s in secrets.find_secrets(text, True)[1] if s[0] == kind]


def test_layers_that_are_no_text_are_scanned():
    latin = "é".encode("latin-1") * 9 + b"\x00" * 40 + SECRET.encode()
    tar = gzip.compress(b"\x00" * 500 + SECRET.encode() + b"\x00" * 500)
    assert spans_of("x " + base64.b64encode(latin).decode())
    assert spans_of("x " + base64.b64encode(tar).decode())
    assert spans_of("x %E9" + wrap("url", SECRET).replace("a", "%61"))
    url = "".join(f"%{b:02X}" for b in b"\xe9" + SECRET.encode())
    assert spans_of("x " + url) == [("assign", 5, 2 + len(url) - 3)]


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress])
def test_compressed_bytes_in_other_encodings(pack):
    packed = pack(SECRET.encode() * 3)
    for text in (urllib.parse.quote(packed), urllib.parse.quote_plus(packed), "".join(f"%{b:02x}" for b in packed), repr(packed), "".join(f"\\x{b:02x}" for b in packed)):
        (_, a, z), *_ = spans_of("é blob: " + text + " end")
        assert 8 <= a < z <= 8 + len(text)


def test_url_safe_base64():
    r = random.Random(6)
    for _ in range(60):
        noise = "".join(chr(r.randint(33, 126)) for _ in range(60))
        for pack in (bytes, zlib.compress, bz2.compress):
            run = base64.urlsafe_b64encode(pack((noise + "\xff\xfe? " + SECRET).encode())).decode().rstrip("=")
            assert spans_of(f"x {run} y"), run


@pytest.mark.parametrize("glue", ["https://h/cb/", "a-", "id_", "x", "xy", "xyz/", "/"])
def test_base64_glued_to_what_is_before_it(glue):
    run = wrap("base64", "token=abcdefgh12345678 ")
    for tail in ("", "/more/of/the/path/and/on"):
        got = spans_of(glue + run.rstrip("=") + tail)
        assert ("assign", len(glue), len(glue) + 30) in got


@pytest.mark.parametrize("newline", ["\n", "\r\n", "\n    ", "\\n", "%0A"])
@pytest.mark.parametrize("width", [16, 64, 76])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress, bz2.compress, lzma.compress])
def test_line_wrapped_base64(newline, width, pack):
    r = random.Random(7)
    noise = "".join(chr(r.randint(33, 126)) for _ in range(300))
    run = base64.b64encode(pack((noise + " é " + SECRET + " " + noise + " " + SECRET).encode())).decode()
    text = newline.join(run[i : i + width] for i in range(0, len(run), width))
    for before, after in (("", ""), ("", "\n"), ("", "\n\nnext one"), ("data: ", " end"), ("-----BEGIN X-----\n", "\n-----END X-----")):
        got = spans_of(before + text + after)
        assert len(got) >= (2 if pack is bytes else 1)
        assert all(len(before) - 6 <= a < z <= len(before + text) + 9 for _, a, z in got)


def test_secret_across_a_line_end_maps_through_the_break():
    run = wrap("base64", "x" * 50 + " token=abcdefgh12345678 ")
    text = run[:76] + "\r\n" + run[76:]
    assert ("assign", 68, 68 + 30 + 2) in spans_of(text)


def test_narrow_lines_reach_the_scan(spark, make_docs):
    run = wrap("base64", SECRET)
    text = "\n".join(run[i : i + 16] for i in range(0, len(run), 16))
    assert "assign" in secrets.report(make_docs([(1, text, "a")])).first().spans


def test_random_bytes_hold_nothing():
    run = base64.b64encode(random.Random(1).randbytes(1 << 20)).decode()
    assert secrets.find_secrets(run, True)[1] == []


def test_long_runs_map_exactly():
    one = "token=abcdefgh12345678" + " " * 5
    for n in (40, 4000):
        run = wrap("base64", one * n)
        assert [s for s in spans_of(run)] == [("assign", 36 * k, 36 * k + 30) for k in range(n)]
        assert secrets.redacted(run, spans_of(run)).count("[assign removed]") == n


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress])
def test_every_member_is_read(pack):
    noise = random.Random(8).randbytes(50_000)
    packed = pack(noise) + pack(b"more") + pack(SECRET[:20].encode()) + pack(SECRET[20:].encode())
    (_, a, z), *_ = spans_of("x " + base64.b64encode(packed).decode() + " y")
    assert (a, z) == (2, 2 + -(-len(packed) * 8 // 6))


@pytest.mark.parametrize("most", [100, 64 << 20])
def test_long_layers_are_read_to_their_end(most):
    inner = SECRET + " " + wrap("base64", "AKIA" + "B" * 20) + " " + wrap("url", "%" + "0123456789abcdef0 ") + "\n".join([wrap("gzip", "f" * 20)] * 2)
    for pack in (gzip.compress, bz2.compress, lzma.compress):
        text = "x " + base64.b64encode(pack(b" " * 5_000_000 + inner.encode() + b" " * 100_000)).decode()
        found = secrets.find_secrets(text, True, secrets.Params(max_layer=most))[1]
        assert {k for k, a, z in found if a >= 2 and z <= len(text)} == set(secrets.KINDS)


def test_beyond_the_memory_bound():
    packed = gzip.compress(b" " * ((64 << 20) + 1000) + SECRET.encode(), 1)
    assert spans_of("x " + base64.b64encode(packed).decode())


def test_deep_compression():
    data = SECRET.encode()
    for _ in range(40):
        data = gzip.compress(data)
    assert spans_of("x " + base64.b64encode(data).decode())


def test_short_lines_before_a_longer_one():
    for first in ("a", "ab", "abc", "abcd", "abcde"):
        assert secrets.find_secrets(first + "\nsomething_quite_longer here", True)[1] == []
