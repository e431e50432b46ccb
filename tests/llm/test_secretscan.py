"""Plain findings against the kinds' definitions; decoded ones against planted wrappings."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import subprocess
import sys
import urllib.parse
import zlib
from pathlib import Path

import pytest

from tillpoint.llm import secretscan as S

ROOT = Path(__file__).parents[2]
SECRET = 'password = "hunter2hunter"'
ASSIGN = re.compile("([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
                    "|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def b64(x):
    return base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()


def escapes(x):
    return "".join(f"\\u{ord(c):04x}" for c in x)


def percent(x):
    return "".join(f"%{b:02X}" for b in x.encode())


def brute(text):
    t = text or ""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[1], S.KINDS.index(s[0])))


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


WRAPS = {
    "base64": b64, "url": percent, "unicode": escapes,
    "zlib": lambda x: b64(zlib.compress(x.encode())), "gzip": lambda x: b64(gzip.compress(x.encode())),
    "bz2": lambda x: b64(bz2.compress(x.encode())), "xz": lambda x: b64(lzma.compress(x.encode())),
    "entities": lambda x: "".join(f"&#{ord(c)};" for c in x), "hex entities": lambda x: "".join(f"&#x{ord(c):x};" for c in x),
    "urlsafe": lambda x: base64.urlsafe_b64encode(x.encode()).decode(),
    "bytes": lambda x: "".join(f"\\x{ord(c):02x}" for c in x),
}


@pytest.mark.parametrize("outer", WRAPS)
@pytest.mark.parametrize("inner", ["", *WRAPS])
def test_wrapped_twice(outer, inner):
    hidden = WRAPS[outer](WRAPS[inner](SECRET) if inner else SECRET)
    text = f"é before {hidden} after\nnext line"
    base, every, cut = S.find(text)
    assert cut == 0
    at = text.index(hidden)
    found = [(a, b) for k, a, b in every if k == "assign" and (k, a, b) not in base]
    assert found, text
    assert all(at <= a < b <= at + len(hidden) for a, b in found)


def test_spans_map_to_the_hiding_characters():
    text = "x pass%77ord%20%3D%20abcdefg y"
    assert S.find(text)[1] == [("assign", 2, 28)]
    text = "token = ab\\u0063def, fine"
    assert S.find(text)[1] == [("assign", 0, text.index(","))]
    prefix = "nothing to see here; "
    text = b64(prefix + "AKIA" + "Q7" * 9 + " and more")
    (_, a, b), = S.find(text)[1]
    raw = base64.b64decode(text[a // 4 * 4:b + -b % 4])
    assert b"AKIA" + b"Q7" * 9 in raw and b - a < 36


def test_cycles_and_fixpoints_end():
    assert S.find("%2525252541%25" * 50 + " " + b64(b64(b64("nothing here at all"))))[0] == []
    deep = SECRET
    for _ in range(12):
        deep = b64(deep)
    assert S.find(deep)[1]


def test_a_large_payload_is_bounded_and_reported():
    text = b64(zlib.compress(b"a" * 3_000_000 + SECRET.encode()))
    assert S.find(text, max_layer=1 << 20)[2] >= 1
    assert S.find(text)[1] and S.find(text)[2] == 0


def test_random_texts_equal_the_definition():
    rng = random.Random(4)
    bits = ["password", "TOKEN", "api_key", "apikey", "paſſword", "secret", "=", ":", " ", "'", '"', "abcdef", "x.y-z", "AKIA",
            "ABCDEFGH12345678", "0123456789abcdef", "deadbeef00", "\n", "é", "_", "+/"]
    for _ in range(4000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        assert S.find(text)[0] == brute(text)
        assert set(brute(text)) <= set(S.find(text)[1])


def test_scan_of_tables(odd, documents):
    for df in (odd, documents):
        rows = {(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()}
        got = S.scan(df).collect()
        assert len(got) == df.count()
        want = sorted((str(d), digest(brute(t)), [k for k, _, _ in brute(t)].count("assign")) for d, t in rows)
        assert sorted({(str(r.doc_id), r.base_sha256, r.n_assign) for r in got}) == sorted(set(want))


def test_redaction(frame, odd):
    df = frame([(1, f"a {SECRET} b"), (2, None), (3, f"x {b64(SECRET)} y"), (4, "clean")], ["n_chars", "row"])
    got = {r.doc_id: r.text for r in S.redact(df, length_col=None).collect()}
    assert got[1] == 'a [SECRET]" b' and got[2] is None and got[4] == "clean"
    assert SECRET not in got[3] and "[SECRET]" in got[3] and "hunter2" not in str(S.find(got[3]))
    assert not any(S.find(t)[1] for t in got.values())
    assert sorted(map(str, S.redact(odd, length_col=None).collect())) == sorted(map(str, odd.collect()))


def test_length_column_stays_true(spark):
    df = spark.createDataFrame([(1, SECRET, len(SECRET)), (2, None, None), (3, "ok", 2)], "doc_id long, text string, n_chars long")
    assert {r.doc_id: r.n_chars for r in S.redact(df).collect()} == {1: len('[SECRET]"'), 2: None, 3: 2}


def test_empty_table(frame):
    assert S.scan(frame([])).collect() == [] and S.redact(frame([]), length_col=None).collect() == []


@pytest.mark.parametrize("width", [64, 76, 20])
@pytest.mark.parametrize("pack", [lambda x: x.encode(), lambda x: zlib.compress(x.encode()), lambda x: gzip.compress(x.encode())])
def test_wrapped_lines_are_read_as_one_run(width, pack):
    rng = random.Random(width)
    noise = lambda n: " ".join("".join(rng.choices("ghijklmnop", k=6)) for _ in range(n))
    for at in range(0, 12):
        hidden = b64(pack(noise(20) + "." * at + " " + SECRET + " " + noise(20)))
        for feed in ("\n", "\r\n", "\n  "):
            lines = [hidden[i:i + width] for i in range(0, len(hidden), width)]
            for head in ("", "data: ", "averyveryverylongword\n"):
                text = head + feed.join(lines) + "\nThe end"
                every = [(a, b) for k, a, b in S.find(text)[1] if k == "assign"]
                assert every and all(len(head) <= a < b <= len(text) - 8 for a, b in every), (text, every)
                assert not S.find(S.redacted(text, S.find(text)[1], "[SECRET]"))[1]


@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress])
def test_every_payload_is_scanned_whatever_its_characters(pack):
    plain = f"config {SECRET} end"
    for odd in ("\u00a0", "\u3000", "\ufeff", "\u200b", "\0", "\x07", "\x1b", "é", "日本"):
        raws = [f"{odd}{plain}{odd}".encode()]
        raws += [f"{odd}{plain}{odd}".encode(c) for c in ("utf-16", "utf-16-le", "utf-16-be", "utf-32-le")]
        raws += [b"\xe9\xff " + plain.encode() + b" \xe9"]
        for raw in raws:
            hidden = b64(pack(raw))
            text = f"x {hidden} y"
            found = [(a, b) for k, a, b in S.find(text)[1] if k == "assign"]
            assert found and all(2 <= a < b <= len(text) - 2 for a, b in found), raw
            if pack is not gzip.compress:
                got = base64.b64decode(text[2 + (found[0][0] - 2) // 4 * 4:2 + -(-(found[0][1] - 2) // 4) * 4])
                assert b"hunter2hunter" in got.replace(b"\0", b"") and len(got) < len(raw)


@pytest.mark.parametrize("pack", [zlib.compress, gzip.compress, bz2.compress, lzma.compress])
def test_a_secret_behind_the_bound_is_found(pack):
    rng = random.Random(1)
    words = ["plain", "words", "été", "日本語", "here, and", "there."]
    noise = lambda n: " ".join(rng.choices(words, k=n))
    for secret in (SECRET, b64("some " + SECRET), percent(SECRET)):
        text = b64(pack((noise(60_000) + " " + secret + " " + noise(30_000)).encode()))
        assert [k for k, _, _ in S.find(text, max_layer=1 << 16)[1]] == ["assign"] and S.find(text, max_layer=1 << 16)[2] == 0
    text = b64(pack(b"a" * 3_000_000 + SECRET.encode() + "é".encode() * 100_000))
    got = S.find(text, max_layer=1 << 20)
    assert got[1] and got[2] >= 1


def test_pieces_lose_no_finding_at_their_ends():
    rng = random.Random(2)
    bits = [SECRET, "api_key  =  abcdefgh", percent("token: abcdefg"), "AKIA" + "Q7" * 9, "0123456789abcdef" * 2, "word", "x.y", ", ",
            "the end. ", " ", "\n", b64(SECRET), "é"]
    for _ in range(150):
        raw = " ".join(rng.choices(bits, k=60)).encode()
        pieces = list(S._pieces((raw[i:i + 50] for i in range(0, len(raw), 50)), 50, 1 << 20))
        assert "".join(p for p, _ in pieces).encode("latin-1") == raw and len(pieces) > 1
        count = lambda t: sum(1 for _ in S.base_spans(t)) + sum(len(S.find(t)[1]) - len(S.find(t)[0]) for _ in "x")
        assert sum(count(p) for p, _ in pieces) == count(raw.decode("latin-1"))


def raw_deflate(x):
    d = zlib.compressobj(wbits=-15)
    return d.compress(x) + d.flush()


def lines(run, width, feed):
    return feed.join(run[i:i + width] for i in range(0, len(run), width))


PACKS = {"plain": lambda x: x, "gzip": gzip.compress, "zlib": zlib.compress, "xz": lzma.compress, "bz2": bz2.compress}
FEEDS = {"json": "\\n", "json crlf": "\\r\\n", "blank": " ", "quoted": "\n> ", "continued": "\\\n", "quoted-printable": "=\n",
         "literals": '"\n    "', "added literals": '" +\n    "', "list": '",\n  "', "lines": "\n", "crlf": "\r\n"}


@pytest.mark.parametrize("feed", FEEDS)
@pytest.mark.parametrize("pack", PACKS)
@pytest.mark.parametrize("width", [5, 12, 16, 64, 76])
def test_base64_wrapped_in_every_way(feed, pack, width):
    rng = random.Random(width)
    noise = " ".join("".join(rng.choices("ghijklmnop", k=6)) for _ in range(20))
    for at in range(4):
        hidden = lines(b64(PACKS[pack]((noise + "." * at + " " + SECRET + " " + noise).encode())), width, FEEDS[feed])
        for head, end in (("", ""), ('{"key": "', '"}'), ("some words, then ", "; that is all"), ("glued", ".")):
            text = head + hidden + end
            every = S.find(text)[1]
            assert [k for k, _, _ in every] == ["assign"] * len(every) and every, text
            assert all(len(head) <= a < b <= len(head) + len(hidden) for _, a, b in every), (text, every)
            assert not S.find(S.redacted(text, every, "[SECRET]"))[1]


@pytest.mark.parametrize("glue", ["x", "ab", "key", "path/to/", "id-", "0x", "word_"])
@pytest.mark.parametrize("pack", [*PACKS, "deflate"])
def test_runs_glued_to_what_stands_before(glue, pack):
    raw = f"the {SECRET} of the house, and much more of it".encode()
    if pack == "deflate" and glue:
        text = glue + ": " + b64(raw_deflate(raw))
    else:
        text = glue + b64(PACKS[pack](raw))
    every = S.find(text)[1]
    assert [k for k, _, _ in every] == ["assign"] and every[0][1] >= len(glue)


def test_deflate_without_a_header():
    rng = random.Random(3)
    for n in range(1, 60, 7):
        raw = " ".join([*rng.choices(["alpha", "beta", "gamma", "delta"], k=n), SECRET, *rng.choices(["one", "two"], k=n)]).encode()
        for width in (24, 64, 10_000):
            hidden = lines(b64(raw_deflate(raw)), width, "\n")
            text = f"data:\n{hidden}\n-- end"
            assert [(k, a >= 6, b <= 6 + len(hidden)) for k, a, b in S.find(text)[1]] == [("assign", True, True)], text


@pytest.mark.parametrize("pack", ["gzip", "zlib", "bz2", "xz"])
def test_compressed_bytes_under_escapes(pack):
    raw = PACKS[pack](f"the {SECRET} of the house, and much more of it".encode())
    forms = {
        "percent": "".join(f"%{c:02x}" for c in raw), "url": urllib.parse.quote(raw), "form": urllib.parse.quote_plus(raw),
        "hex": "".join(f"\\x{c:02x}" for c in raw), "repr": repr(raw), "json": "".join(f"\\u{c:04x}" for c in raw),
        "entities": "".join(f"&#{c};" for c in raw)}
    for name, hidden in forms.items():
        text = f"x {hidden} y"
        every = S.find(text)[1]
        assert [k for k, _, _ in every] == ["assign"], name
        assert 2 <= every[0][1] < every[0][2] <= len(text) - 2


def test_javascript_and_form_escapes():
    hidden = "".join(f"%u{ord(c):04X}" for c in SECRET)
    assert [(k, a, b) for k, a, b in S.find(f"x {hidden} y")[1]] == [("assign", 2, 2 + 6 * (len(SECRET) - 1))]
    text = "q=%70assword+%3D+hunter2hunter&b"
    assert S.find(text)[1] == [("assign", 2, text.index("&"))]


def brute_kinds(text, depth=3):
    """Kinds of findings in any layer, by trying every start: slow and plain."""
    found, met, work = set(), set(), [(text, depth)]
    while work:
        layer, left = work.pop()
        if layer in met:
            continue
        met.add(layer)
        found |= {k for k, _, _ in brute(layer)}
        if not left:
            continue
        raws = [layer.encode("latin-1", "replace")]
        for run in re.findall(r"""(?:[A-Za-z0-9+/_-]|\\[nr]|=\n|["'\s>\\,])+""", layer):
            run = re.sub(r"""\\[nr]|["'\s>\\,=]""", "", run).replace("-", "+").replace("_", "/")
            if len(run) >= 16:
                raws += [base64.b64decode(run[i:][:len(run[i:]) // 4 * 4 + (len(run) - i) % 4 - ((len(run) - i) % 4 == 1)]
                                          + "=" * (-(len(run) - i) % 4 % 3)) for i in range(4)]
        for raw in raws:
            plain = raw.decode("latin-1")
            work += [(plain, left - 1)] if len(re.findall(r"[\x09-\x0d\x20-\x7e\0]{12}", plain)) else []
            if b"\0" in raw:
                work.append((plain.replace("\0", ""), left - 1))
            for i in range(len(raw)):
                for unpack in (lambda x: zlib.decompressobj(47).decompress(x), bz2.decompress, lzma.decompress):
                    if raw[i:i + 1] in (b"\x1f", b"\x78", b"B", b"\xfd"):
                        try:
                            work.append((unpack(raw[i:]).decode("latin-1"), left - 1))
                        except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError):
                            pass
        work.append((re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), layer), left - 1))
        work.append((re.sub(r"\\u([0-9A-Fa-f]{4})", lambda m: chr(int(m[1], 16)), layer), left - 1))
    return found


def test_random_nestings_equal_brute_force():
    rng = random.Random(11)
    secrets = [SECRET, "AKIA" + "Q7" * 9, "0123456789abcdef" * 2, "nothing at all of note here", "api_key=ab", "AKIA short"]
    wraps = [b64, percent, escapes, lambda x: b64(zlib.compress(x.encode())), lambda x: b64(gzip.compress(x.encode())),
             lambda x: b64(x.encode("utf-16")), lambda x: lines(b64(x), rng.choice([10, 16, 64]), rng.choice(["\n", "\\n", " ", "\n> "]))]
    hits = 0
    for _ in range(250):
        inner = "Some words (" + rng.choice(secrets) + ") and more."
        for _ in range(rng.randint(0, 2)):
            inner = rng.choice(wraps)(inner)
        text = rng.choice(["", "Before it: ", "glued", "é ("]) + inner + rng.choice(["", ".", ") after"])
        want = brute_kinds(text)
        assert {k for k, _, _ in S.find(text)[1]} == want, text
        hits += bool(want)
    assert 80 < hits < 220


def test_memory_of_a_very_long_base64_text():
    code = ("import resource, base64; from tillpoint.llm import secretscan as S\n"
            "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
            "raw = b'plain words of a log, line by line.\\n' * 1_050_000\n"
            "text = base64.b64encode(raw + b'password = \"hunter2hunter\"').decode()\n"
            "assert len(text) > 50_000_000\n"
            "del raw\n"
            "(k, a, b), = S.find(text)[1]\n"
            "assert k == 'assign' and a > 50_000_000\n"
            "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)\n")
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT, timeout=300)
    assert got.returncode == 0 and int(got.stdout) < 1000, got
