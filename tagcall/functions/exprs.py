"""Flags, tags, bases and votes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the alphabet in code order; D is a deletion.
ALPHABET = "NATCGD"
#: Fixed value: phred of a deleted position.
DELETED_PHRED = 50
#: Fixed value: unmapped, mate unmapped, secondary, failed, duplicate, supplementary.
REJECTED_FLAGS = 0x4 | 0x8 | 0x100 | 0x200 | 0x400 | 0x800
#: Fixed value: combinations of present tag slots (bits F1, F2, R1, R2) that are accepted.
TAG_MASKS = (1, 4, 5, 6, 9, 15)
TAG_WIDTH = 16
MIN_TAG = 3
#: Order in which a row prints its six counts.
PRINTED = "ATCGND"


def has_flag(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def is_forward(flag: Column) -> Column:
    return ~has_flag(flag, 0x10)


def is_usable(flag: Column) -> Column:
    return ~has_flag(flag, REJECTED_FLAGS)


def is_proper_pair(flag: Column) -> Column:
    return flag.bitwiseAND(F.lit(3)) == 3


def orientation(flag: Column) -> Column:
    """FR, RF, FF or RR, tried in that order; null if none fits."""
    first, second = has_flag(flag, 0x40), has_flag(flag, 0x80)
    rev, mate = has_flag(flag, 0x10), has_flag(flag, 0x20)
    return (
        F.when((first & ~rev & mate) | (second & rev & ~mate), "FR")
        .when((first & rev & ~mate) | (second & ~rev & mate), "RF")
        .when(~rev & ~mate, "FF")
        .when(rev & mate, "RR")
    )


def tag_slot(qname: Column, slot: int) -> Column:
    """Tag text of slot 0 to 3 (F1, F2, R1, R2): every second piece of the name, empty if absent."""
    return slot_of(F.split(qname, "_"), slot)


def slot_of(pieces: Column, slot: int) -> Column:
    return F.coalesce(F.try_element_at(pieces, F.lit(2 * slot + 3)), F.lit(""))


def tag_mask(f1: Column, f2: Column, r1: Column, r2: Column) -> Column:
    """Bit i: slot i holds a tag of three letters or more."""
    return sum(F.when(F.length(t) >= MIN_TAG, 1 << i).otherwise(0) for i, t in enumerate((f1, f2, r1, r2)))


def tag_select(slots: tuple[Column, ...], wanted: tuple[int, ...]) -> Column:
    """The tag of the lowest wanted slot that holds one; null if none does."""
    return F.coalesce(*(F.when(F.length(slots[i]) >= MIN_TAG, slots[i]) for i in sorted(wanted)))


def tag_letters(tag: Column) -> Column:
    return F.when(F.translate(tag, ALPHABET, "") == "", tag).otherwise(F.regexp_replace(tag, f"[^{ALPHABET}]", "N"))


def tag16(tag: Column) -> Column:
    """The printed form: the last 16 letters, reversed, padded with N."""
    return F.rpad(F.reverse(F.right(tag_letters(tag), F.lit(TAG_WIDTH))), TAG_WIDTH, "N")


def tag_key(tag: Column) -> Column:
    """Sorts as the packed tag does: 16 digits, the last letter lowest."""
    return F.translate(F.lpad(F.right(tag_letters(tag), F.lit(TAG_WIDTH)), TAG_WIDTH, "N"), ALPHABET, "012345")


def packed(key: Column) -> Column:
    """The tag as an integer, four bits a letter."""
    return F.conv(key, 16, 10).cast("long")


def unpacked(number: Column) -> Column:
    """The key of a packed tag."""
    return F.lpad(F.hex(number), TAG_WIDTH, "0")


def base_code(base: Column) -> Column:
    return F.greatest(F.instr(F.lit(ALPHABET), base) - 1, F.lit(0))


def code_base(code: Column) -> Column:
    return F.substring(F.lit(ALPHABET), code + 1, F.lit(1))


def count_letter(tag: Column, letter: str) -> Column:
    return F.length(tag) - F.length(F.replace(tag, F.lit(letter), F.lit("")))


def lower_bound(a: Column, b: Column) -> Column:
    """At most the edit distance of two tags: half the summed differences of letter counts."""
    return F.floor(sum(F.abs(count_letter(a, x) - count_letter(b, x)) for x in "NATCG") / 2).cast("int")


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def single(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def below_share(part: Column, share: float, whole: Column) -> Column:
    """part < share * whole, in single precision."""
    return single(part) < single(share) * single(whole)


def percent(part: Column, whole: Column) -> Column:
    """Two decimals, a dash without a denominator."""
    return F.when(whole == 0, "-").otherwise(F.format_string("%.2f", 100.0 * part / whole))
