"""Section files byte by byte, both layouts, and what is refused."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lanewright.sources import sections
from lanewright.sources.sections import END, LAYOUTS, MAGIC, names, parse, unparse

HEAD = MAGIC + struct.pack("<HH6HIqI", 1, 0, 4096, 4099, 4096, 2, 50, 0, 19656, -7, 0)
BITS = {"B": 8, "H": 16, "I": 32, "i": 31, "q": 60}


def _slice(vals=None):
    """One entry of a data-flow slice, by hand: two program counters, one leaf, no operations."""
    out = struct.pack("<HBBIBBBxHiBB", 4096, 4, 0, 9, 0, 0, 0, 80, -2, 1, 3) + struct.pack("<HHH", 2, 7, 8) + struct.pack("<HBxHBx", 1, 1, 500, 6) + struct.pack("<H", 0)
    return out if vals is None else out + struct.pack("<H", len(vals)) + bytes(vals)


@pytest.mark.parametrize("tail", [b"", b"TMPO" + struct.pack("<HHBB", 1, 30, 5, 0), END, b"IWLK" + struct.pack("<IHBxIB", 1, 9, 7, 1, 3) + END])
@pytest.mark.parametrize("vals", [None, [], [1, 2, 3]])
def test_both_layouts_by_hand(tail, vals):
    """The section is followed by the end of the file, another section, or the end mark."""
    data = HEAD + b"SDDF" + struct.pack("<I", 2) + _slice(vals) * 2 + tail
    found = [e for e in parse(data) if e[0] == "SDDF"]
    lists = [[7, 8], [1], [500], [6], []] + ([] if vals is None else [vals])
    assert found == [("SDDF", k, ((4096, 4, 0, 9, 0, 0, 0, 80, -2, 1, 3), lists)) for k in (0, 1)]
    assert [e[0] for e in parse(data, {"TMPO"})] == ["TMPO"] * (b"TMPO" in tail)


def test_what_is_not_a_file_is_refused():
    with pytest.raises(ValueError, match="not a file of sections"):
        list(parse(b"RIFF" + HEAD[4:]))
    with pytest.raises(ValueError, match="unknown section"):
        list(parse(HEAD + b"WHAT" + bytes(8)))
    with pytest.raises(ValueError, match="cut off"):
        list(parse(HEAD + b"SIDW" + struct.pack("<I", 3) + bytes(12)))
    with pytest.raises(ValueError, match="cut off"):
        list(parse(HEAD + b"SNAP" + struct.pack("<I", 90) + bytes(12)))
    with pytest.raises(ValueError, match="ends at no section"):
        list(parse(HEAD + b"SDDF" + struct.pack("<I", 1) + _slice() + b"??" + END))


@st.composite
def _files(draw):
    out = []
    for tag, layout in LAYOUTS.items():
        extra = draw(st.booleans())
        for k in range(1 if not layout.count else draw(st.integers(0, 3))):
            size = draw(st.integers(0, 4))
            fields = [f.split(":") for f in layout.head if f[0] != "_"]
            head = tuple(size if n == "n" and layout.lists else draw(st.integers(-(1 << BITS[c]) + 1 if c in "iq" else 0, (1 << BITS[c]) - 1)) for n, c in fields)
            lists = []
            for items in layout.lists + layout.extra * extra:
                n = size if items.count == "n" else draw(st.integers(0, 3))
                lists += [draw(st.lists(st.integers(0, (1 << BITS[f.split(":")[1]]) - 1), min_size=n, max_size=n)) for f in items.fields if f[0] != "_"]
            out.append((tag, k, (head, lists)))
    return out


@settings(max_examples=150, deadline=None)
@given(_files())
def test_any_file_is_read_as_it_was_written(entries):
    """But for a file that happens to fit the newer layout too: it is read so, which the format can't tell."""
    data = unparse(entries)
    if list(parse(data)) != entries:
        assert unparse(list(parse(data))) == data


def test_files_from_disk(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(HEAD + b"SNAP" + struct.pack("<I", 11) + struct.pack("<HH3s", 10, 3, b"abc") + struct.pack("<HH", 12, 0) + b"ACMP" + struct.pack("<IHBHB", 6, 2, 5, 65535, 1) + END)
    (tmp_path / "b.bin").write_bytes(HEAD + b"DIGI" + struct.pack("<IIB3xII", 100, 16, 0, 1, 2) + b"PWLK" + struct.pack("<IHBBBBIH", 1, 2, 1, 0, 3, 0, 9, 1) + struct.pack("<HI", 77, 5) + END)
    rows = sections.section_files(spark, str(tmp_path)).cache()
    one = lambda df: sorted((r["path"][-5], *r[1:]) for r in df.collect())
    assert [r[:4] for r in one(sections.section(rows, "HEAD"))] == [("a", 0, 1, 4096), ("b", 0, 1, 4096)]
    assert one(sections.memory(rows)) == [("a", 10, 97), ("a", 11, 98), ("a", 12, 99)]
    bits = one(sections.access_bits(rows))
    assert len(bits) == 65536 and bits[:3] == [("a", 0, 5), ("a", 1, 5), ("a", 2, 1)]
    assert one(sections.sample_streams(rows)) == [("b", True)]
    walk = sections.section(rows, "PWLK").collect()[0]
    assert (walk["pointer"], walk["frame"], walk["y"], walk["pc"]) == ([77], [5], None, None)
    assert names(LAYOUTS["HEAD"].head)[-1] == "size"
    assert sections.write_sections(rows).count() == 2
