"""Per-row helpers: hashes, stemmer, HTML extraction, parameter rules."""

import hashlib

import numpy as np
import pytest

from nearspark import params
from nearspark.functions.hashing import MERSENNE_32, md5_32_py, minhash_coefficients, murmur3_32
from nearspark.functions.html import extract_fields
from nearspark.functions.porter import stem_word


def test_murmur3_known_vectors():
    assert murmur3_32(b"foo", 0) == 4138058784
    signed = murmur3_32(b"foo", 42)
    signed = signed - (1 << 32) if signed >= 1 << 31 else signed
    assert signed == -1322301282
    assert murmur3_32(b"", 0) == 0


def test_md5_mod_reduction_equals_big_int():
    for s in ["a1", "word12", "x" * 50, "caf1"]:
        full = int(hashlib.md5(s.encode()).hexdigest(), 16) % MERSENNE_32
        h = hashlib.md5(s.encode()).hexdigest()
        words = sum(int(h[8 * i:8 * i + 8], 16) for i in range(4)) % MERSENNE_32
        assert full == words


def test_minhash_coefficients_range_and_determinism():
    a, b = minhash_coefficients(128, 42)
    assert a.min() >= 1 and a.max() <= MERSENNE_32 - 1
    assert b.min() >= 1 and b.max() <= MERSENNE_32 - 1
    a2, _ = minhash_coefficients(128, 42)
    assert np.array_equal(a, a2)
    assert a[0] == 1 + md5_32_py("a:42:0") % (MERSENNE_32 - 1)


@pytest.mark.parametrize("word,stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("caress", "caress"),
    ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"),
    ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"),
    ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("tanned", "tan"),
    ("falling", "fall"), ("hissing", "hiss"), ("fizzed", "fizz"), ("failing", "fail"),
    ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"),
    ("conditional", "condit"), ("rational", "ration"), ("valenci", "valenc"),
    ("digitizer", "digit"), ("generalization", "gener"), ("electrical", "electr"),
    ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"), ("allowance", "allow"),
    ("adjustment", "adjust"), ("adoption", "adopt"), ("controll", "control"), ("roll", "roll"),
    ("dying", "die"), ("news", "news"), ("is", "is"), ("running", "run"), ("generously", "gener"),
])
def test_porter_examples(word, stem):
    assert stem_word(word) == stem


def test_html_heading_in_nav_is_heavy_and_nav_removed():
    heavy, light = extract_fields("<nav><h2>Menu Title</h2><a>link</a></nav><p>body</p>")
    assert "Menu Title" in heavy and "link" not in light and "body" in light


def test_html_img_alt_rules():
    html = ("<p><img src=a alt='Alt One'><img src=b></p><h1>T <img alt='lost'></h1>"
            "<nav><img alt='navalt'></nav>")
    heavy, light = extract_fields(html)
    assert "Alt One" in light and "lost" not in light + heavy and "navalt" not in light


def test_html_inline_tags_split_words_and_entities():
    heavy, light = extract_fields("<p><b>foo</b>bar &amp; caf&eacute;</p>")
    assert light.split()[:2] == ["foo", "bar"] and "&" in light and "é" in light


def test_html_non_text_nodes():
    html = ("<!DOCTYPE html><!-- c --><script>var x='<p>s</p>'</script><style>p{}</style>"
            "<template><p>tpl</p></template><title>Ttl</title><p>x<![CDATA[cd]]></p>")
    heavy, light = extract_fields(html)
    words = light.split()
    assert "Ttl" in words and "x" in words and "cd" in words
    assert not {"c", "s", "tpl", "var"} & set(words)


def test_html_nested_headings_counted_once_and_unclosed():
    heavy, _ = extract_fields("<h1>outer <h2>inner</h2></h1><p>unclosed <b>bold")
    assert heavy.split() == ["outer", "inner"]
    assert extract_fields(None) == ("", "")


def test_parameter_rules():
    with pytest.raises(ValueError):
        params.check_minhash(8, 16)          # more bands than hashes
    assert params.check_minhash(130, 16) == 8  # leftover hashes are allowed
    with pytest.raises(ValueError):
        params.check_simhash(0, 3)
    with pytest.raises(ValueError):
        params.check_lsa(10, 1.5)
    with pytest.raises(ValueError):
        params.check_method("bogus")


def test_local_path_strips_file_scheme():
    from nearspark.session import local_path
    assert local_path("file:/tmp/x") == "/tmp/x"
    assert local_path("file:///tmp/x") == "/tmp/x"
    assert local_path("/tmp/x") == "/tmp/x"


def test_warc_bodies_are_decoded():
    import gzip
    import zlib

    from nearspark.sources.warc import _parse_record

    def record(head, body):
        block = b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body
        return (b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: u\r\nContent-Length: "
                + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    page = "<p>caf\u00e9</p>".encode()
    packed = gzip.compress(page)
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in (packed[:7], packed[7:])) + b"0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    for head, body in ((b"Content-Type: text/html", page), (b"Content-Encoding: gzip", packed),
                       (b"Content-Encoding: gzip", page), (b"Content-Encoding: deflate", zlib.compress(page)),
                       (b"Content-Encoding: deflate", raw.compress(page) + raw.flush()),
                       (b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip", chunked),
                       (b"Transfer-Encoding: chunked", page)):
        assert _parse_record(record(head, body)) == ("response", "u", page.decode())
    for head, body in ((b"Content-Encoding: br", b"??"), (b"Transfer-Encoding: chunked", b"ff\r\nshort")):
        with pytest.raises(ValueError):
            _parse_record(record(head, body))
