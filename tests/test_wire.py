"""Containers: golden cases, damage, ciphers, charsets, both versions."""

from __future__ import annotations

import io

import pytest

from keyloom.sources.wire.charset import Charset
from keyloom.sources.wire.codec import lzo1x
from keyloom.sources.wire.crypto import Passcode, ripemd128
from keyloom.sources.wire.errors import ContainerError
from keyloom.sources.wire.layout import Container
from keyloom.sources.wire.limits import Limits
from tests.encode import container


def fails(kind, fn):
    with pytest.raises(ContainerError) as e:
        fn()
    assert e.value.kind == kind, e.value


def text_rows(c):
    return [(o, k, c.text(s, e)) for o, k, s, e in c.rows()]


G15 = [("alpha", "AA"), ("duplicate", "111"), ("duplicate", "2222"), ("empty", ""), ("following", "F"), ("omega", "OO")]


def test_vectors():
    assert ripemd128(b"").hex() == "cdf26213a150dc3ecb610f18f6b38b46"
    assert ripemd128(b"a").hex() == "86be7afa339d0fc7cfc785e72f578d33"
    assert lzo1x(bytes([20, *b"abc", 0x48, 0, 17, 0, 0]), 6) == b"abcabc"
    assert Charset("gb18030").decode(bytes.fromhex("9439fc36"), "x") == "😀"
    assert Charset("gbk").decode(b"\x80a\xb0\xa1", "x") == "€a啊"


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("codec", ["none", "zlib", "lzo"])
def test_records_cross_blocks(version, codec):
    codecs = (codec if version == 2 else "none", codec, codec)
    c = Container(container("mdx", G15, version, key_blocks=[2, 2, 2], record_blocks=[1, 5, 2, 4], codecs=codecs), "mdx")
    assert len(c) == 6
    assert text_rows(c) == [(i, k, v) for i, (k, v) in enumerate(G15)]
    assert [c.row(i, False)[1] if c.row(i, False) else None for i in (5, 1, 1, 6)] == ["omega", "duplicate", "duplicate", None]
    assert c.row(3)[2:] == (9, 9)
    sink = io.BytesIO()
    assert c.copy_to(0, 9, sink) == 9 and sink.getvalue() == b"AA1112222"


@pytest.mark.parametrize("version", [1, 2])
def test_resources(version):
    data = [("\\big.bin", bytes(range(201))), ("\\none.bin", b""), ("\\big.bin", b"\x01")]
    c = Container(container("mdd", data, version, record_blocks=[50, 50, 50, 52]), "mdd")
    assert [c.payload(s, e) for _, _, s, e in c.rows()] == [x for _, x in data]
    assert c.locate("\\big.bin") == ("RawExact", [0, 2])
    assert c.locate("big.bin") == ("HeaderNormalized", [0, 2])
    fails("InvalidFormat", lambda: c.text(0, 1))


@pytest.mark.parametrize(("charset", "label", "key"), [("utf-8", "UTF-8", "café😀"), ("utf-16-le", "UTF-16", "词典😀"), ("gbk", "GBK", "汉语"), ("gb18030", "GB18030", "😀词"), ("big5", "Big5", "詞典")])
@pytest.mark.parametrize("version", [1, 2])
def test_charsets(version, charset, label, key):
    c = Container(container("mdx", [(key, key + "!"), ("z", "z")], version, charset, label, key_blocks=[1, 1]), "mdx")
    assert text_rows(c) == [(0, key, key + "!"), (1, "z", "z")]


def test_empty():
    for version in (1, 2):
        c = Container(container("mdx", [], version), "mdx")
        assert len(c) == 0 and list(c.rows()) == [] and c.locate("x") is None and c.row(0) is None


def test_lookup_rules():
    def one(keys, query, **attributes):
        return Container(container("mdx", [(k, k) for k in keys], attributes=attributes, key_blocks=[1] * len(keys)), "mdx").locate(query)

    assert one(["TARGET", "Target", "target"], "target") == ("RawExact", [2])
    assert one(["duplicate"] * 5, "duplicate") == ("RawExact", [0, 1, 2, 3, 4])
    assert one(["TARGET", "target", "Target", "tArGeT", "target"], "target") == ("RawExact", [1, 4])
    assert one(["CaseSensitive"], "casesensitive", KeyCaseSensitive="Yes") is None
    assert one([" Foo-Bar_Baz! ", "FOO\tBAR.BAZ", "foo/bar+baz", "fOo:bAr@bAz"], "FOO\rBAR#BAZ", StripKey="Yes") == ("HeaderNormalized", [0, 1, 2, 3])
    assert one(["foo bar", "foo—bar"], "foo bar", StripKey="Yes") is None
    assert one(["foo bar", "foo—bar"], "FOO BAR", StripKey="Yes") == ("HeaderNormalized", [0])
    assert one(["NEEDLE!", "Needle?"], "needle", STRIPKEY="Yes") == ("HeaderNormalized", [0, 1])


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_encryption(bits):
    code = ("0123456789abcdef0123456789abcdef", "fixture-user@example.com")
    data = container("mdx", G15, encrypted=bits, passcode=code)
    assert text_rows(Container(data, "mdx", Passcode(*code)))[0] == (0, "alpha", "AA")
    if bits & 1:
        fails("MissingPasscode", lambda: Container(data, "mdx"))
        fails("ChecksumMismatch", lambda: Container(data, "mdx", Passcode(code[0], "other")))
    fails("Unsupported", lambda: Container(container("mdx", G15, 1, attributes={"Encrypted": str(bits)}), "mdx"))
    fails("InvalidPasscode", lambda: Passcode("12", "x"))


def test_legacy_layout():
    c = Container(container("mdx", G15, legacy=True, codecs=("zlib", "zlib", "none"), key_blocks=[2, 4]), "mdx")
    assert [k for _, k, _, _ in c.rows(spans=False)] == [k for k, _ in G15]


def test_versions():
    def engine(generated, required, **more):
        return lambda: Container(container("mdx", G15, attributes={"GeneratedByEngineVersion": generated, "RequiredEngineVersion": required}, **more), "mdx")

    engine("2.0", "1.2")()
    fails("Unsupported", engine("2.0", "3.0"))
    fails("InvalidFormat", engine("2.0", "2.bad"))
    fails("Unsupported", engine("3.0", "2.bad"))
    fails("Unsupported", engine("3.0", "2.0", label="ISO8859-1"))
    fails("InvalidFormat", engine("1.2", "2.0"))


def test_attribute_aliases():
    fails("InvalidData", lambda: Container(container("mdx", G15, attributes={"StripKey": "Yes", "STRIPKEY": "No"}), "mdx"))
    Container(container("mdx", G15, attributes={"StripKey": "Yes", "STRIPKEY": "yes"}), "mdx")


def test_lazy_damage():
    c = Container(container("mdx", [("alpha", "A"), ("omega", "O")], key_blocks=[1, 1], record_blocks=[1, 1], spoil_record=1), "mdx")
    rows = list(c.rows())
    assert c.text(*rows[0][2:]) == "A"
    fails("ChecksumMismatch", lambda: c.text(*rows[1][2:]))
    c = Container(container("mdx", [("alpha", "A"), ("beta", "B"), ("omega", "O")], key_blocks=[2, 1], spoil_key=1), "mdx")
    seen = []
    fails("ChecksumMismatch", lambda: seen.extend(iter(c.rows(spans=False))))
    c = Container(container("mdx", [("alpha", "A"), ("omega", "O")], starts=[2, 1]), "mdx")
    fails("InvalidData", lambda: list(c.rows()))
    c = Container(container("mdx", [("a", "xxxxx"), ("b", ""), ("c", "y")], key_blocks=[1, 2], starts=[5, 1, 6]), "mdx")
    fails("InvalidData", lambda: c.row(2))
    for off in (-1, 1):
        entries = [("alpha", "A"), ("omega", "O")]
        try:
            c = Container(container("mdx", entries, count_off=off), "mdx")
        except ContainerError:
            continue
        fails("InvalidData", lambda c=c: list(c.rows()))
    fails("InvalidFormat", lambda: list(Container(container("mdx", [("actual-key", "x")], summaries=[("other", "actual-key")]), "mdx").rows()))


def test_limits():
    data = container("mdx", G15)
    for name, value in (("header_attributes", 1), ("header_xml_bytes", 10), ("key_index_bytes", 8), ("record_index_bytes", 8), ("decompressed_block_bytes", 4), ("block_metadata_bytes", 0)):
        fails("LimitExceeded", lambda n=name, v=value: Container(data, "mdx", limits=Limits(**{n: v})))
    c = Container(data, "mdx", limits=Limits(materialized_record_bytes=2))
    fails("LimitExceeded", lambda: c.text(2, 5))
    fails("LimitExceeded", lambda: Container(data, "mdx", limits=Limits(locator_entries=2)).locate("x"))
    assert Limits.of({"limits": "large", "limit.locator_entries": "-1"}).locator_entries == (1 << 32) - 1


@pytest.mark.parametrize("version", [1, 2])
def test_mutations_and_truncations_never_escape(version):
    data = container("mdx", G15, version, key_blocks=[3, 3], codecs=("zlib" if version == 2 else "none", "lzo", "zlib"))
    whole = text_rows(Container(data, "mdx"))

    def attempt(bad):
        try:
            return text_rows(Container(bad, "mdx"))
        except ContainerError:
            return None

    for i in range(len(data)):
        attempt(data[:i] + bytes([data[i] ^ 0x5A]) + data[i + 1 :])
    for i in range(1, len(data)):
        assert attempt(data[:i]) is None
    assert attempt(data) == whole


def test_wrong_grammar_is_not_retried():
    one, two = container("mdx", G15, 1), container("mdx", G15, 2)
    for head, body in ((one, two), (two, one)):
        n, m = (int.from_bytes(x[:4], "big") + 8 for x in (head, body))
        with pytest.raises(ContainerError):
            Container(head[:n] + body[m:], "mdx")


def test_errors_pickle():
    import pickle

    e = ContainerError("Truncated", "x", needed=3)
    again = pickle.loads(pickle.dumps(e))
    assert (again.kind, again.fields, str(again)) == ("Truncated", {"needed": 3}, str(e))


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("encoding", ["UTF-8", "UTF-16", "GB18030", "Big5"])
def test_written_containers(version, encoding):
    from keyloom.sources.wire.writer import Style, Writer

    rows = [(f"詞{i // 3}", f"第{i}" * (i % 7)) for i in range(50)]
    for more in ({}, {"codec": "none"}, {"encrypted": 2}, {"encrypted": 3, "passcode": Passcode("0123456789abcdef" * 2, "user")}):
        if version == 1 and "encrypted" in more:
            fails("Unsupported", lambda m=more: Writer("mdx", Style(1, **m)))
            continue
        w, sink = Writer("mdx", Style(version, encoding, keys=7, record_bytes=40, attributes={"Title": "a \"b\" & 'c' <d>"}, **more)), io.BytesIO()
        for row in rows:
            w.add(*row)
        assert w.close(sink) == 50
        c = Container(sink.getvalue(), "mdx", more.get("passcode"))
        assert text_rows(c) == [(i, k, v) for i, (k, v) in enumerate(rows)]
        assert c.layout.header.title == "a \"b\" & 'c' <d>" and len(c.layout.key_blocks) == 8 and c.locate("詞1") == ("RawExact", [3, 4, 5])
        assert c.prefix_keys("詞1", 4) == [3, 4, 5, 30]
    w, sink = Writer("mdd", Style(version, keys=2, record_bytes=3)), io.BytesIO()
    for key, body in (("\\a.bin", b"12345"), ("\\b", b""), ("\\c", b"\0\0")):
        w.add(key, body)
    w.close(sink)
    assert [c.payload(s, e) for c in [Container(sink.getvalue(), "mdd")] for _, _, s, e in c.rows()] == [b"12345", b"", b"\0\0"]
    sink = io.BytesIO()
    assert Writer("mdx").close(sink) == 0 and len(Container(sink.getvalue(), "mdx")) == 0
    fails("InvalidData", lambda: Writer("mdx").add("a\0b", ""))


def test_memory_is_charged():
    data = container("mdx", G15 * 50, key_blocks=[100] * 3, record_blocks=[100] * 6, codecs=("zlib", "zlib", "zlib"))
    c = Container(data, "mdx")
    opened = c.memory_usage()
    assert opened.metadata_bytes == c.layout.metadata_bytes == opened.current_bytes and opened.peak_bytes >= opened.current_bytes and not opened.locator_bytes
    rows = list(c.rows())
    assert c.text(*rows[7][2:]) == "111"
    c.locate("alpha")
    used = c.memory_usage()
    assert used.key_cache_bytes and used.record_cache_bytes == 100 and used.locator_bytes == 4 + sum(12 + len(k) for k, _ in G15 * 50)
    assert used.current_bytes == used.metadata_bytes + used.locator_bytes + used.key_cache_bytes + used.record_cache_bytes
    for low in range(0, used.peak_bytes, used.peak_bytes // 40):
        def attempt(low=low):
            small = Container(data, "mdx", limits=Limits(working_memory_bytes=low))
            list(small.rows())
            small.text(*rows[7][2:])
            small.locate("alpha")

        fails("LimitExceeded", attempt)
    assert Container(data, "mdx", limits=Limits(working_memory_bytes=used.peak_bytes)).locate("alpha") == c.locate("alpha")
    fails("LimitExceeded", lambda: Container(data, "mdx", limits=Limits(locator_bytes=used.locator_bytes - 1)).locate("x"))
    again = Container(data, "mdx", limits=Limits(locator_bytes=used.locator_bytes - 1))
    fails("LimitExceeded", lambda: again.locate("x"))
    assert again.memory_usage().locator_bytes == 0 and again.memory_usage().current_bytes == again.memory_usage().metadata_bytes + again.memory_usage().key_cache_bytes


def test_first_lookup_from_many_threads():
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    c, start = Container(container("mdx", [(f"k{i}", "x") for i in range(3000)], key_blocks=[100] * 30), "mdx"), Barrier(8)

    def look(i):
        start.wait()
        return c.locate(f"k{i * 300}")

    with ThreadPoolExecutor(8) as pool:
        assert list(pool.map(look, range(8))) == [("RawExact", [i * 300]) for i in range(8)]


def test_random_input_never_escapes():
    import random

    from keyloom.sources.wire.codec import decode_block
    from keyloom.sources.wire.header import parse_tag

    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choices("<>/=\"' abDictionary&;#x\n\0é", k=rng.randrange(40)))
        data = bytes([rng.choice([0, 1, 2, rng.randrange(256)]), 0, 0, 0]) + rng.randbytes(rng.randrange(60))
        for attempt in (lambda t=text: parse_tag("<D " + t, Limits()), lambda d=data: decode_block("x", d, rng.randrange(80), Limits()), lambda d=data: Container(d, "mdx"), lambda d=data: lzo1x(d, 100)):
            try:
                attempt()
            except ContainerError:
                pass
