"""The 105 integer features of a request, in the order of the model's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalar import block_mask, crossing, direction_code, int_div, nearest, zone
from ..plans.arch import Arch


def first_ids(df: DataFrame, name: str, pos: str) -> DataFrame:
    """(name, id): dense ids by first appearance."""
    seen = df.groupBy(name).agg(F.min(pos).alias("_p"))
    return seen.select(name, (F.row_number().over(W.orderBy("_p")) - 1).cast("int").alias(f"{name}_id"))


def decode_ports(ports: DataFrame) -> DataFrame:
    """port_id with family, lane, domain, wire, compass, variant, bank and suffix codes of its name.

    A letter outside its alphabet raises. ``ports`` is the chip's table of names, some hundreds of rows.
    """
    name = F.col("name")
    family = F.regexp_replace(name, r"\[\d+\]$", "")
    lane = F.coalesce(F.regexp_extract(name, r"\[(\d+)\]$", 1).try_cast("int"), F.lit(0))
    first = F.substring(name, 1, 1)
    wired, banked = first.isin("Z", "I"), first.isin("A", "S")
    letter = lambda use, at: F.when(use, F.substring(name, at, 1)).otherwise("-")

    def code(alphabet: str, c: Column) -> Column:
        at = F.instr(F.lit(alphabet), c)
        return F.when((at == 0) | (c == ""), F.raise_error(F.concat(F.lit("unexpected letter in port name "), name)).cast("int")).otherwise(at - 1)

    d = ports.select(
        "port_id", family.alias("family"), lane.alias("lane"), code(fixed.DOMAINS, first).alias("domain"), code(fixed.WIRES, letter(wired, 2)).alias("wire"),
        code(fixed.COMPASS, letter(wired, 3)).alias("compass"), code(fixed.VARIANTS, letter(wired & (F.length(family) == 4), 4)).alias("variant"),
        code(fixed.BANKS, letter(banked, 3)).alias("bank"), F.when(banked, F.substring(name, 4, 100)).otherwise("-").alias("suffix"),
    )
    d = d.join(F.broadcast(first_ids(d, "family", "port_id")), "family").join(F.broadcast(first_ids(d, "suffix", "port_id")), "suffix")
    return d.select("port_id", F.col("family_id").alias("family"), "lane", "domain", "wire", "compass", "variant", "bank", F.col("suffix_id").alias("suffix"))


PORT_PARTS = ["family", "lane", "domain", "wire", "compass", "variant", "bank", "suffix"]


def displacement(sx: Column, sy: Column, tx: Column, ty: Column) -> dict[str, Column]:
    dx, dy = tx - sx, ty - sy
    return {
        "dx": dx, "dy": dy, "adx": F.abs(dx), "ady": F.abs(dy), "manhattan": F.abs(dx) + F.abs(dy), "chebyshev": F.greatest(F.abs(dx), F.abs(dy)),
        "direction": direction_code(dx, dy), "mid_x": int_div(sx + tx, 2), "mid_y": int_div(sy + ty, 2),
    }


def side(x: Column) -> Column:
    return F.when(x < 76, 0).when(x <= 89, 1).otherwise(2)


def opening(y100: Column) -> Column:
    return F.when(y100 >= 50, 0).otherwise(F.least(50 - y100, y100 + 1))


def feature_columns(arch: Arch) -> list[Column]:
    """f0..f104 over columns sx, sy, sp, tx, ty, tp, s_* and t_* port codes, and the search features."""
    c = F.col
    sx, sy, tx, ty = c("sx"), c("sy"), c("tx"), c("ty")
    d = displacement(sx, sy, tx, ty)
    v, h = crossing(sx, tx, arch.vertical), crossing(sy, ty, arch.horizontal)
    blocks = block_mask(sx, sy, tx, ty, arch.block_list)
    zs = [zone(sx, arch.vertical), zone(sy, arch.horizontal), zone(tx, arch.vertical), zone(ty, arch.horizontal)]
    n_y = len(arch.horizontal) + 1
    mod = [sy % 100, ty % 100, d["mid_y"] % 100]
    out = [sx, sy, tx, ty, d["dx"], d["dy"], d["adx"], d["ady"], d["manhattan"], d["chebyshev"], c("sp"), c("tp"), d["direction"], d["mid_x"], d["mid_y"]]
    out += [v[0], h[0], v[1], h[1], blocks, *zs, zs[0] * n_y + zs[1], zs[2] * n_y + zs[3]]
    out += [nearest(sx, arch.vertical), nearest(tx, arch.vertical), nearest(sy, arch.horizontal), nearest(ty, arch.horizontal)]
    out += [d["adx"] % 10, d["ady"] % 12, v[2], h[2]]
    out += [c(f"{e}_{p}") for p in PORT_PARTS for e in ("s", "t")]
    out += [*mod, int_div(sy, 50), int_div(ty, 50), side(sx), side(tx)]
    out.append((((sx < 76) & (tx > 89)) | ((tx < 76) & (sx > 89))).cast("int"))
    out += [opening(mod[0]), opening(mod[1])]
    bit = lambda m, i: F.shiftright(m, i).bitwiseAND(F.lit(1))
    out += [bit(v[2], i) for i in range(len(arch.vertical))] + [bit(h[2], i) for i in range(len(arch.horizontal))] + [bit(blocks, i) for i in range(len(arch.block_list))]
    out += [F.coalesce(c(n), F.lit(-1)) for n in fixed.SEARCH_COLUMNS]
    return [x.cast("int") for x in out]


def features(estimates: DataFrame, arch: Arch) -> DataFrame:
    """KEYS, raw and ``features`` array<int> of estimates with the search features."""
    codes = decode_ports(arch.ports)
    df = estimates
    for e, key in (("s", "sp"), ("t", "tp")):
        df = df.join(F.broadcast(codes.withColumnsRenamed({p: f"{e}_{p}" for p in PORT_PARTS} | {"port_id": key})), key)
    return df.select("sx", "sy", "sp", "tx", "ty", "tp", "raw", F.array(*feature_columns(arch)).alias("features"))
