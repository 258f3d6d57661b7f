"""Damaged archives and very long broken pages: a defined result, in bounded time."""

import gzip
import random
import time

import pytest

from lonja.llm import html_text, warc


def _record(length, block=b"GET / HTTP/1.1\r\n\r\n", kind="request"):
    head = b"WARC/1.1\r\nWARC-Type: " + kind.encode() + b"\r\nWARC-Record-ID: <urn:a>\r\n" + (b"" if length is None else b"Content-Length: " + length + b"\r\n")
    return head + b"\r\n" + block + b"\r\n\r\n"


GOOD = _record(b"18")


@pytest.mark.parametrize("length", [b"abc", b"", b"-3", b"1e3", b"9" * 30, "٣".encode(), None, b"19000000"])
def test_malformed_lengths(length):
    kinds = [r["type"] for r in warc.parse_records(GOOD + _record(length) + GOOD)]
    assert kinds == ["request", "broken"]


def test_revisit_without_a_length():
    block = b"HTTP/1.1 200 OK\r\nContent-Length: many\r\n\r\n"
    (row,) = warc.parse_records(_record(str(len(block)).encode(), block, "revisit"))
    assert (row["type"], row["payload_bytes"]) == ("revisit", None)


def test_damaged_and_cut_gzip():
    r, whole = random.Random(4), [r["type"] for r in warc.parse_records(GOOD * 200)]
    plain = b"".join(_record(b"400", r.randbytes(400)) for _ in range(200))
    for packed in (gzip.compress(plain), b"".join(gzip.compress(plain[k : k + 5000]) for k in range(0, len(plain), 5000))):
        assert [x["type"] for x in warc.parse_records(packed)] == whole
        for _ in range(60):
            cut = bytearray(packed[: r.randrange(3, len(packed) - 1)])
            kinds = [x["type"] for x in warc.parse_records(bytes(cut))]
            assert kinds.count("broken") <= 1 and set(kinds[:-1]) <= {"request"}
            bad = bytearray(packed)
            for _ in range(5):
                bad[r.randrange(12, len(bad))] ^= 1 << r.randrange(8)
            for row in warc.parse_records(bytes(bad)):  # no exception; damage inside a block may pass unseen until the checksum
                assert row["type"] in ("request", "broken", None) or row["type"]
    assert list(warc.parse_records(b"")) == []
    assert [x["type"] for x in warc.parse_records(gzip.compress(GOOD)[:-4])] == ["request", "broken"]


@pytest.mark.parametrize("page", ["<div>x" * 200_000, "<b><p></i>y" * 100_000, "<span><p>z</p>" * 70_000, "<div class='nav main'>t</em>" * 40_000, "<svg><g><div>v" * 70_000, "<a" * 500_000, "<a \"x" * 200_000, "x" * 1_000_000])
def test_pages_of_a_megabyte_of_broken_markup(page):
    times = []
    for part in (page[: len(page) // 8], page):
        began = time.process_time()
        blocks = html_text.leaf_blocks(part)
        html_text.block_features(blocks)
        times.append(time.process_time() - began)
    assert times[1] < 24 * max(times[0], 0.05)  # eight times the page: far from 64 times the time


def test_plain_text_is_one_block():
    assert [(b.text, b.own) for b in html_text.leaf_blocks(" plain \n text ")] == [("plain text", "body")]
    assert html_text.leaf_blocks(None) == [] and html_text.leaf_blocks("<div></div>") == []
