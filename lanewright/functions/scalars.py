"""Column functions on integers: variable-length codes, pitch, phases and rotations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the pitch scale: clock of the chip, accumulator size, reference pitch.
CLOCK_HZ, ACCUMULATOR, A4_HZ = 985248, 1 << 24, 440.0


def zigzag(n: Column) -> Column:
    """0, -1, 1, -2, ... become 0, 1, 2, 3, ..."""
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def leb16_length(n: Column) -> Column:
    """Digits of a number of at least 0 in base 16."""
    return F.greatest(F.length(F.hex(n)), F.lit(1)).cast("int")


def leb16(n: Column) -> Column:
    """Digits in base 16, the least first; the last one has 16 added."""
    digits = F.transform(F.sequence(F.lit(0), leb16_length(n) - 1), lambda k: F.call_function("shiftrightunsigned", n, (4 * k).cast("int")).bitwiseAND(15))
    return F.transform(digits, lambda d, k: d + F.when(k == leb16_length(n) - 1, 16).otherwise(0))


def pitch_grid(fn: Column) -> Column:
    """Nearest semitone from the reference pitch, halves to even; null for 0."""
    return F.when(fn > 0, F.rint(12 * F.log2(fn / F.lit(A4_HZ * ACCUMULATOR / CLOCK_HZ))).cast("int"))


def tri_phase(ctr: Column) -> Column:
    """A triangle of eight steps: 0 to 3 and back."""
    low = ctr.bitwiseAND(7)
    return F.when(low >= 4, low.bitwiseXOR(F.lit(7).cast("long"))).otherwise(low)


def rotation(xs: Column) -> Column:
    """The least of all rotations of an array that is not empty."""
    n = F.size(xs)
    return F.array_min(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(F.slice(xs, k + 1, n - k), F.slice(xs, 1, k))))


def first_difference(a: Column, b: Column) -> Column:
    """Index of the first place where two arrays differ, else the shorter length."""
    n = F.least(F.size(a), F.size(b))
    at = F.filter(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x, i: F.when(~x["a"].eqNullSafe(x["b"]), i)), lambda x: x.isNotNull())
    return F.least(n, F.coalesce(F.element_at(F.when(F.size(at) > 0, at), 1), n))


def unzigzag(n: Column) -> Column:
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-n.bitwiseAND(1))


def unleb16(digits: Column) -> Column:
    """The number of an array of base-16 digits, the least first."""
    return F.aggregate(F.reverse(digits), F.lit(0).cast("long"), lambda a, d: a * 16 + d.cast("long").bitwiseAND(15))


def pitch_hz(fn: Column) -> Column:
    return fn * F.lit(CLOCK_HZ / ACCUMULATOR)


def grid_pitch(grid: Column) -> Column:
    """The nearest accumulator step of a semitone from the reference pitch, halves to even; the inverse of pitch_grid."""
    return F.rint(F.lit(A4_HZ * ACCUMULATOR / CLOCK_HZ) * F.pow(F.lit(2.0), grid / F.lit(12.0))).cast("long")


#: Atoms of the flat alphabet. Rests, key off, key on, raw bytes from 20 on; semitones -80 to 79 from 64 on; bytes.
REST, KEY_OFF, KEY_ON, RAW, NOTE_ZERO, BYTE_ZERO, ATOMS = 17, 18, 19, 20, 144, 320, 576


def byte_atom(v: Column) -> Column:
    """The atom of a byte; an error for other numbers."""
    return F.when(v.between(0, 255), v + BYTE_ZERO).otherwise(F.raise_error(F.lit("not a byte")).cast("long"))


def word_atoms(v: Column) -> Column:
    """Two atoms, the low byte first."""
    return F.array(byte_atom(v.bitwiseAND(255)), byte_atom(F.shiftright(v, 8)))


def note_atom(fn: Column) -> Column:
    """The atom of a pitch: rest for 0, the semitone if the pitch is exactly its step, else null (it needs its raw bytes)."""
    grid = pitch_grid(fn)
    return F.when(fn == 0, REST).when((grid_pitch(grid) == fn) & grid.between(-80, 79), grid + NOTE_ZERO).cast("long")


def byte_share(atoms: Column) -> Column:
    """The share of an array's atoms that are bytes."""
    n = F.size(F.filter(atoms, lambda a: (a >= BYTE_ZERO) & (a < ATOMS)))
    return F.when(F.size(atoms) > 0, n / F.size(atoms)).otherwise(F.lit(0.0))


def feeds(mask: Column, reg: Column) -> Column:
    """Whether the bit of a register is set."""
    return F.call_function("shiftright", mask, reg.cast("int")).bitwiseAND(1) == 1


def falls_by_one(v: Column, least: int = 3, frames: int = 8) -> Column:
    """Whether the high byte falls by one against two frames before, in at least so many of the first frames of an array."""
    high = F.transform(F.slice(v, 1, frames), lambda x: F.shiftright(x, 8).bitwiseAND(255))
    steps = F.transform(high, lambda x, i: F.when(i >= 2, F.get(high, i - 2) - x))
    return F.size(F.filter(steps, lambda d: d == 1)) >= least
