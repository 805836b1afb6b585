"""Registered queries of section files: tables are written to files, half of them in the older layout, and read from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import provenance
from ..sources import sections
from .engine_queries import _BUS, bus_log
from .queries import LOG, SQL, Q, add

#: What the tables are made of: for each tune and register, writes and distinct values.
_REGS = ", regs AS (SELECT tune_id, reg, count(*) AS n, arg_max(val, seq) AS last, min(val) AS lo, max(val) AS hi, sum(val)::BIGINT AS total, list_sort(list(DISTINCT val)) AS vs, row_number() OVER (PARTITION BY tune_id ORDER BY reg) - 1 AS k FROM log GROUP BY 1, 2)"


def _files(log: DataFrame) -> DataFrame:
    _path, _reg = F.col("tune_id"), F.col("reg")
    regs = log.groupBy("tune_id", "reg").agg(F.count("*").alias("n"), F.max_by("val", "seq").alias("last"), F.min("val").alias("lo"), F.max("val").alias("hi"), F.sum("val").alias("total"), F.array_sort(F.collect_set("val")).alias("vs"))
    tunes = log.groupBy("tune_id").agg(F.count("*").alias("n"), F.max(F.col("clock") % 1000).alias("t0"))
    zero, vs = F.lit(0), F.col("vs")
    of = lambda f: F.transform("vs", f)
    pc = (F.lit(4096) + _reg).alias("pc")
    size = F.size("vs").alias("n")
    slices = regs.select("tune_id", "reg", pc, *(zero.alias(c) for c in ("phase", "kind", "low", "high", "base", "stride")), F.col("n").alias("count"), "lo", "hi", vs.alias("pcs"), of(lambda x: x % 5).alias("leaf_kind"), of(lambda x: x * 3).alias("leaf_addr"), vs.alias("leaf_val"), of(lambda x: x % 13).alias("ops"), vs.alias("vals"))
    walks = regs.select("tune_id", "reg", F.col("reg").alias("zp"), F.lit(sections.LOADS).alias("flags"), "lo", "hi", F.col("n").alias("count"), size, of(lambda x: 4096 + x).alias("pointer"), of(lambda x: x * 700).alias("frame"), vs.alias("y"), of(lambda x: x + 1).alias("pc"))
    odd = F.col("tune_id") % 2 == 1
    old = [n for items in sections._SLICE.lists for n in sections.names(items.fields)]
    rows = lambda df, tag, lists=None: sections.as_rows(df, tag, _path, _reg, lists)
    tables = [
        sections.as_rows(tunes.select("tune_id", F.lit(1).alias("version"), F.lit(4096).alias("init"), F.lit(4099).alias("play"), F.lit(4096).alias("load"), F.col("tune_id").alias("subtune"), (F.col("n") % 65536).alias("frames"), F.lit(19656).alias("cycles"), (-F.col("t0")).alias("t0"), zero.alias("size")), "HEAD", _path, zero),
        rows(regs.select("tune_id", "reg", pc, F.col("n").alias("count"), "last"), "SIDW"),
        rows(regs.select("tune_id", "reg", pc, F.col("lo").alias("base"), (_reg - 12).alias("stride"), "lo", "hi", F.col("n").alias("count")), "IDXR"),
        rows(regs.filter("reg % 2 = 0").select("tune_id", "reg", pc, (_reg % 8).alias("flags"), zero.alias("n"), (_reg - 3).alias("scale"), F.col("hi").alias("base"), F.expr("shiftleft(1L, reg)").alias("feeds"), *(zero.alias(c) for c in ("idx0", "idx1", "addr0", "addr1"))), "IDXS"),
        rows(slices.filter(odd), "SDDF"), rows(slices.filter(~odd), "SDDF", old),
        rows(walks.filter(odd), "PWLK"), rows(walks.filter(~odd), "PWLK", ["pointer", "frame"]),
        rows(regs.select("tune_id", "reg", _reg.alias("addr"), F.lit(1).alias("flags"), "total", zero.alias("first"), size, vs.alias("samples")), "STSQ"),
        rows(regs.select("tune_id", "reg", (_reg * 200).alias("addr"), size, vs.alias("bytes")), "SNAP"),
        rows(regs.select("tune_id", "reg", (F.col("n") % 60000).alias("run"), (F.col("last") % 64).alias("bits")), "ACMP"),
        rows(regs.filter("reg % 3 = 0").select("tune_id", "reg", pc, (_reg % 3 * 7).alias("voice"), size, vs.alias("index")), "IWLK"),
        sections.as_rows(tunes.select("tune_id", (F.col("n") * 1000 % 1000000).alias("mean1000"), (F.col("tune_id") * 5).alias("most"), (F.col("tune_id") % 2).alias("table"), zero.alias("frames"), F.col("n").alias("writes")), "DIGI", _path, zero),
        rows(regs.select("tune_id", "reg", F.col("total").alias("_t"), _reg.alias("cell"), F.col("lo").alias("reload")), "TMPO"),
    ]
    return sections.write_sections(reduce(DataFrame.unionByName, tables))


def _tune(df: DataFrame) -> DataFrame:
    return df.withColumn("tune_id", F.col("path").cast("long")).drop("path")


def _entries(log: DataFrame) -> DataFrame:
    rows = _tune(sections.read_sections(_files(log)))
    text = lambda x: F.concat_ws(",", x.cast("array<string>"))
    return rows.select("tune_id", "section", "entry", text(F.col("head")).alias("head"), F.concat_ws(";", F.transform("lists", text)).alias("lists"))


def _line(tag: str, head: str, lists: str = "''", where: str = "true") -> str:
    return f"SELECT tune_id, '{tag}' AS section, k::INT AS entry, concat_ws(',', {head}) AS head, {lists} AS lists FROM regs WHERE {where}"


_v = lambda f="x": f"array_to_string(list_transform(vs, lambda x: {f}), ',')"
_slice = ["array_to_string(vs, ',')", _v("x % 5"), _v("x * 3"), "array_to_string(vs, ',')", _v("x % 13")]
_walk = [_v("4096 + x"), _v("x * 700")]
_half = lambda own, more: f"CASE WHEN tune_id % 2 = 1 THEN concat_ws(';', {', '.join(own + more)}) ELSE concat_ws(';', {', '.join(own)}) END"
_nth = lambda n: f"k, row_number() OVER (PARTITION BY tune_id ORDER BY reg) - 1 AS n{n}"
_ENTRIES = " UNION ALL ".join([
    "SELECT tune_id, 'HEAD' AS section, 0 AS entry, concat_ws(',', 1, 4096, 4099, 4096, tune_id, count(*) % 65536, 19656, -max(clock % 1000), 0) AS head, '' AS lists FROM log GROUP BY 1",
    "SELECT tune_id, 'DIGI', 0, concat_ws(',', count(*) * 1000 % 1000000, tune_id * 5, tune_id % 2, 0, count(*)), '' FROM log GROUP BY 1",
    _line("SIDW", "4096 + reg, reg, n, last"), _line("IDXR", "4096 + reg, lo, reg - 12, lo, hi, n"), _line("TMPO", "reg, lo"), _line("ACMP", "n % 60000, last % 64"),
    _line("SDDF", "4096 + reg, reg, 0, n, 0, 0, 0, 0, 0, lo, hi", _half(_slice, ["array_to_string(vs, ',')"])),
    _line("PWLK", "reg, 1, lo, hi, n, len(vs)", _half(_walk, ["array_to_string(vs, ',')", _v("x + 1")])),
    _line("STSQ", "reg, 1, total, 0, len(vs)", "array_to_string(vs, ',')"), _line("SNAP", "reg * 200, len(vs)", "array_to_string(vs, ',')"),
    "SELECT tune_id, 'IDXS', (row_number() OVER w - 1)::INT, concat_ws(',', 4096 + reg, reg % 8, 0, reg - 3, hi, 1 << reg, 0, 0, 0, 0), '' FROM regs WHERE reg % 2 = 0 WINDOW w AS (PARTITION BY tune_id ORDER BY reg)",
    "SELECT tune_id, 'IWLK', (row_number() OVER w - 1)::INT, concat_ws(',', 4096 + reg, 0, len(vs)), array_to_string(vs, ',') FROM regs WHERE reg % 3 = 0 WINDOW w AS (PARTITION BY tune_id ORDER BY reg)",
])
add("section_entries", _entries, LOG + _REGS, _ENTRIES)
add("section_memory", lambda x: _tune(sections.memory(sections.read_sections(_files(x), ["SNAP"]))), LOG + _REGS, "SELECT tune_id, reg * 200 + generate_subscripts(vs, 1) - 1 AS addr, unnest(vs) AS byte, reg FROM regs".join(["SELECT tune_id, addr::BIGINT AS addr, arg_max(byte, reg) AS byte FROM (", ") GROUP BY 1, 2"]))
add("section_access", lambda x: _tune(sections.access_bits(sections.read_sections(_files(x), ["ACMP"]))), LOG + _REGS, """, s AS (SELECT tune_id, n % 60000 AS run, last % 64 AS bits, coalesce(sum(n % 60000) OVER (PARTITION BY tune_id ORDER BY reg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM regs)
SELECT tune_id, unnest(range(start, least(start + run, 65536))) AS addr, bits FROM s WHERE start < 65536""")
add("section_reads", lambda x: _tune(sections.reads(sections.read_sections(_files(x), ["IDXR", "IDXS", "IWLK"]))).withColumn("walks", F.concat_ws(",", F.col("walks").cast("array<string>"))), LOG + _REGS, """SELECT tune_id, 4096 + reg AS pc, lo AS base, reg - 12 AS stride, lo, hi, n AS count, CASE WHEN reg % 2 = 0 THEN reg % 2 = 1 END AS fitted, CASE WHEN reg % 2 = 0 THEN reg - 3 END AS scale,
CASE WHEN reg % 2 = 0 THEN hi END AS base_fit, CASE WHEN reg % 2 = 0 THEN 1 << reg END AS feeds, CASE WHEN reg % 2 = 0 THEN (reg % 8) & 2 = 2 END AS inside, CASE WHEN reg % 2 = 0 THEN (reg % 8) & 6 = 6 END AS pointers, CASE WHEN reg % 3 = 0 THEN '0' ELSE '' END AS walks FROM regs""")
_inside = lambda x: sections.reads(sections.read_sections(_files(x), ["IDXR", "IDXS", "IWLK"]))


def _pointers(log: DataFrame) -> DataFrame:
    files = _files(log)
    return provenance.pointer_sequences(_inside(log), sections.memory(sections.read_sections(files, ["SNAP"])), ["path"], 0, 5000)


def _used(log: DataFrame) -> DataFrame:
    return sections.access_bits(sections.read_sections(_files(log), ["ACMP"]))


def _banks(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    extents = provenance.read_extents(_used(log), ["path"], 0, 5000)
    shifts = log.select(F.col("tune_id").cast("string").alias("path")).distinct().select("path", F.explode(F.array(F.lit(0), F.lit(64))).alias("delta"))
    return provenance.read_banks(_pointers(log), extents, shifts, ["path"])


_MEM = ", mem AS (SELECT tune_id, addr, arg_max(byte, reg) AS byte FROM (SELECT tune_id, reg * 200 + generate_subscripts(vs, 1) - 1 AS addr, unnest(vs) AS byte, reg FROM regs) GROUP BY 1, 2)"
_PTRS = _MEM + """, cand AS (SELECT tune_id, 4096 + reg AS pc, lo AS base, lo, hi, p.packing, p.step, CASE WHEN p.packing = 'split' THEN hi - lo + 1 ELSE 1 END AS off FROM regs, (VALUES ('interleaved', 2), ('split', 1), ('adjacent', 1)) p(packing, step)
WHERE reg % 2 = 0 AND reg & 2 = 2 AND hi - lo + 1 BETWEEN 2 AND 512 AND (p.packing <> 'interleaved' OR reg - 12 = 2)), idx AS (SELECT *, unnest(range(lo, hi + 1)) AS i FROM cand),
ptrs AS (SELECT c.tune_id, pc, base, packing, i AS k, coalesce(a.byte, 0) + 256 * coalesce(b.byte, 0) AS pointer FROM idx c LEFT JOIN mem a ON a.tune_id = c.tune_id AND a.addr = base + step * i LEFT JOIN mem b ON b.tune_id = c.tune_id AND b.addr = base + step * i + off)"""
add("pointer_sequences", lambda x: _tune(_pointers(x)), LOG + _REGS, _PTRS[2:].join([", ", " SELECT * FROM ptrs"]))
_EXT = """, s AS (SELECT tune_id, n % 60000 AS run, last % 64 AS bits, coalesce(sum(n % 60000) OVER (PARTITION BY tune_id ORDER BY reg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM regs),
ac AS (SELECT tune_id, unnest(range(start, least(start + run, 65536))) AS addr, bits FROM s WHERE start < 65536), rd AS (SELECT tune_id, addr, addr - row_number() OVER (PARTITION BY tune_id ORDER BY addr) AS g FROM ac WHERE bits & 16 = 16 AND addr < 5000),
ext AS (SELECT tune_id, addr, least(max(addr) OVER (PARTITION BY tune_id, g) - addr + 1, 1024) AS length FROM rd)"""
add("read_extents", lambda x: _tune(provenance.read_extents(_used(x), ["path"], 0, 5000)), LOG + _REGS, _EXT[2:].join([", ", " SELECT * FROM ext"]))
_BANK = _PTRS + _EXT + """, rs AS (SELECT p.tune_id, pc, packing, d AS delta, k, ((pointer - d) % 65536 + 65536) % 65536 AS src FROM ptrs p, (VALUES (0), (64)) v(d)), hit AS (SELECT rs.*, length FROM rs LEFT JOIN ext e ON e.tune_id = rs.tune_id AND e.addr = src),
sc AS (SELECT tune_id, pc, packing, delta, count(DISTINCT src) FILTER (length IS NOT NULL) AS patterns, count(length) AS walked FROM hit GROUP BY 1, 2, 3, 4 HAVING patterns >= 2 AND 5 * patterns <= 4 * walked),
best AS (SELECT tune_id, pc, packing, delta FROM sc QUALIFY row_number() OVER (PARTITION BY tune_id ORDER BY patterns DESC, pc, packing, delta) = 1), won AS (SELECT h.* FROM hit h JOIN best USING (tune_id, pc, packing, delta)),
bank AS (SELECT tune_id, pc, packing, delta, src, length, row_number() OVER (PARTITION BY tune_id ORDER BY src) - 1 AS pattern FROM (SELECT DISTINCT tune_id, pc, packing, delta, src, length FROM won WHERE length IS NOT NULL))"""
add("pattern_banks", lambda x: _tune(_banks(x)[0]), LOG + _REGS, _BANK[2:].join([", ", " SELECT * FROM bank"]))
add("pattern_orders", lambda x: _tune(_banks(x)[1]), LOG + _REGS, _BANK[2:].join([", ", " SELECT w.tune_id, k, pattern FROM won w LEFT JOIN bank b ON b.tune_id = w.tune_id AND b.src = w.src"]))
_bit = lambda b: provenance.fed(b.withColumn("val", F.col("val") % 2), ["tune_id"])
_FED = _BUS + """, o AS (SELECT *, last_value(CASE WHEN rw = 0 THEN {'a': addr, 'v': val % 2} END IGNORE NULLS) OVER (PARTITION BY tune_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS l FROM bus),
fed AS (SELECT tune_id, seq, (addr - 54272)::INT AS reg, CASE WHEN l.v = val % 2 THEN l.a END AS addr FROM o WHERE rw = 1 AND addr BETWEEN 54272 AND 54296)"""
Q["fed_writes"], SQL["fed_writes"] = lambda spark, sf_dir: _bit(bus_log(spark, sf_dir)), f"WITH {_FED} SELECT * FROM fed"
Q["walked_tables"] = lambda spark, sf_dir: provenance.table_walks(_bit(bus_log(spark, sf_dir)), ["tune_id"])
SQL["walked_tables"] = f"""WITH {_FED}, d AS (SELECT *, addr - lag(addr) OVER w AS d FROM fed WHERE addr IS NOT NULL WINDOW w AS (PARTITION BY tune_id, reg ORDER BY seq)), e AS (SELECT *, CASE WHEN d <> lag(d) OVER (PARTITION BY tune_id, reg ORDER BY seq) THEN 1 ELSE 0 END AS c FROM d),
g AS (SELECT *, sum(c) OVER (PARTITION BY tune_id, reg ORDER BY seq) AS walk FROM e) SELECT tune_id, reg, walk::BIGINT AS walk, min(seq) AS start, arg_min(addr, seq) AS addr, max(d) AS stride, count(*) AS n FROM g GROUP BY 1, 2, 3"""
add("record_tables", lambda x: _tune(provenance.record_tables(provenance.read_leaves(sections.section(sections.read_sections(_files(x), ["SDDF"]), "SDDF")), ["path"], 20, 700)), LOG + _REGS, """, lf AS (SELECT DISTINCT tune_id, reg, v * 3 AS addr FROM (SELECT tune_id, reg, unnest(vs) AS v FROM regs) WHERE v % 5 = 1 AND v * 3 BETWEEN 20 AND 699),
df AS (SELECT *, addr - lag(addr) OVER (PARTITION BY tune_id, reg ORDER BY addr) AS d FROM lf), fl AS (SELECT tune_id, reg, min(addr) AS f, list_reduce(list(d) FILTER (d IS NOT NULL), lambda x, y: gcd(x, y)) AS g, count(*) AS n FROM df GROUP BY 1, 2 HAVING count(*) >= 3),
ct AS (SELECT tune_id, g, count(*) AS m, min(f) AS f FROM fl WHERE g >= 2 GROUP BY 1, 2) SELECT tune_id, min(f)::BIGINT AS base, (first(g ORDER BY m DESC, g))::BIGINT AS stride FROM ct GROUP BY 1""")
add("section_streams", lambda x: _tune(sections.sample_streams(sections.read_sections(_files(x), ["DIGI"]))), LOG, "SELECT tune_id, tune_id * 5 >= 16 AND tune_id % 2 = 0 AS digital FROM log GROUP BY 1")
