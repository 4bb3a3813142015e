"""Visually identical text with different characters: a confusables skeleton, and groups of equal skeleton."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaymark.session import materialise

# Letters of other alphabets (Cyrillic, Greek, Cherokee, Lisu, Coptic, Armenian and number forms) that are drawn
# like one of another alphabet, by that letter.
LOOKALIKES = {
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐ", "C": "СϹᏟⅭꓚⲤ", "D": "ᎠⅮꓓ", "E": "ЕΕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "НΗᎻꓧⲎ", "I": "ІΙӀⅠꓲⲒ", "J": "ЈͿᎫꓙ", "K": "КΚᏦꓗⲔ", "L": "ᏞⅬꓡ", "M": "МΜϺᎷⅯꓟⲘ",
    "N": "ΝꓠⲚ", "O": "ОΟՕꓳⲞ", "P": "РΡᏢꓑⲢ", "Q": "Ԛ", "R": "ᎡᏒꓣ", "S": "ЅՏᏚꓢ", "T": "ТΤᎢꓔⲦ", "U": "Սᑌꓴ", "V": "ѴᏙⅤꓦ", "W": "ԜᎳꓪ", "X": "ХΧⅩꓫⲬ", "Y": "УΥҮꓬⲨ", "Z": "ΖᏃꓜⲌ",
    "a": "аαɑ", "b": "Ьᖯ", "c": "сϲⅽⲥꮯ", "d": "ԁⅾ", "e": "еҽ", "f": "ẝ", "g": "ɡց", "h": "һհ", "i": "іιɩⅰ", "j": "јϳ", "k": "κк", "l": "ӏⅼ", "m": "ⅿ", "n": "ոռ", "o": "оοօⲟ",
    "p": "рρⲣ", "q": "ԛզ", "s": "ѕꮪ", "u": "υսʋ", "v": "νѵⅴꮩ", "w": "ԝѡաꮃ", "x": "хχⅹ", "y": "уγү", "z": "ᴢꮓ",
    "Γ": "ГᎱⲄ", "Π": "ПⲠ", "Φ": "ФⲪ", "φ": "ф", "Θ": "ѲⲐ", "Λ": "ꓥⲖ", "Δ": "Ⲇ", "Ψ": "ѰⲮ",
}
# Format characters that are seen (Arabic and other number signs) and controls that move the text stay.
INVISIBLE = regex.compile(r"[\p{Cf}\p{Default_Ignorable_Code_Point}\p{Cc}--[\t\n\r\x0b\x0c\x85\u0600-\u0605\u06dd\u070f\u0890\u0891\u08e2]]+", regex.V1)
CONTROL = regex.compile(r"[\x00-\x08\x0e-\x1f\x7f]+")
BLANK = regex.compile(r"\p{Zs}")
VISIBLE = regex.compile(r"[^\s\p{Z}]")


def _table() -> dict[int, str]:
    """Each character with its prototype: the look-alikes, and full-width and half-width forms by their own rule."""
    out = {ord(c): latin for latin, same in LOOKALIKES.items() for c in same}
    for code in (*range(0xFF01, 0xFFEF), 0x3000, 0x20A9):
        kind, _, rest = unicodedata.decomposition(chr(code)).partition(" ")
        if kind in ("<wide>", "<narrow>"):
            out[code] = "".join(chr(int(x, 16)) for x in rest.split())
    out[0xFF9E], out[0xFF9F] = "゙", "゚"  # half-width sound marks join the letter before them
    out[0x309B], out[0x309C] = "゙", "゚"
    return {code: out.get(ord(p), p) if len(p) == 1 else p for code, p in out.items()}


PROTOTYPES = _table()


def skeleton(text: str) -> str:
    """One form for all texts that look like `text`: decompose, take invisible characters out, replace each character
    by its prototype, make every blank a space, decompose again. Case, accents, superscripts, words, punctuation, line
    breaks, tabs and the number of blanks stay different."""
    if text.isascii():
        return CONTROL.sub("", text)
    plain = INVISIBLE.sub("", unicodedata.normalize("NFD", text)).translate(PROTOTYPES)
    return unicodedata.normalize("NFD", BLANK.sub(" ", plain))


def with_skeleton(df: DataFrame, text: str = "text", to: str = "skeleton") -> DataFrame:
    """Adds the skeleton of `text` (null for null, empty for empty; a column of that name is replaced). No shuffle."""
    kept = [f for f in df.schema.fields if f.name != to]
    schema = T.StructType([*kept, T.StructField(to, T.StringType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [None if x is None else skeleton(x) for x in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(made, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def look_classes(df: DataFrame, item: str, text: str = "text") -> DataFrame:
    """<item>, look (digest of the skeleton), spelling (digest of the text itself): equal look is equal appearance.

    Null texts and texts without a visible character belong to no class. Digests of 256 bits stand for the texts, so
    that the texts themselves are not shuffled.
    """
    seen = with_skeleton(df.filter(F.col(text).isNotNull()).select(item, F.col(text).alias("__text")), "__text", "__skeleton").filter(F.col("__skeleton").rlike(r"[^\s\p{Z}]"))
    return seen.select(item, F.unhex(F.sha2("__skeleton", 256)).alias("look"), F.unhex(F.sha2("__text", 256)).alias("spelling"))


def lookalike_pairs(df: DataFrame, item: str, text: str = "text") -> DataFrame:
    """<item>_a < <item>_b: items whose texts look the same and are spelled differently.

    Only looks with more than one spelling go on: looks are counted by distinct spelling (a partial aggregate, so
    thousands of plain copies are one row), spellings of one look are paired, and items come back by spelling. Plain
    copies are never paired with each other.
    """
    rows = materialise(look_classes(df, item, text), "looks")
    spellings = rows.select("look", "spelling").distinct()
    mixed = spellings.groupBy("look").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("look")
    few = spellings.join(mixed, "look")
    both = few.select("look", F.col("spelling").alias("sa")).join(few.select("look", F.col("spelling").alias("sb")), "look").filter("sa <> sb").select("sa", "sb")
    first = both.join(rows.select(F.col("spelling").alias("sa"), F.col(item).alias(f"{item}_a")), "sa")
    pairs = first.join(rows.select(F.col("spelling").alias("sb"), F.col(item).alias(f"{item}_b")), "sb")
    return pairs.filter(F.col(f"{item}_a") < F.col(f"{item}_b")).select(f"{item}_a", f"{item}_b")
