"""Scalar functions as Column expressions."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def logit(p: Column, clip: float = 1e-6) -> Column:
    bounded = F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip)))  # least and greatest skip nulls
    return F.ln(bounded / (1 - bounded))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def surprise(p: Column, floor: float = 1e-300) -> Column:
    """-log10(p); null where p is null."""
    return F.when(p.isNotNull(), -F.log10(F.greatest(p, F.lit(floor))))  # greatest skips nulls


def half_life_weight(age_seconds: Column, half_life: float) -> Column:
    return F.pow(F.lit(2.0), -age_seconds / half_life)


def bucket_end(at: Column, width: int = 300) -> Column:
    """End (seconds) of the bucket [start, end) that holds `at`: an event on a boundary belongs to the next bucket."""
    return (F.floor(F.unix_seconds(at) / width) + 1) * width


def feature_bucket_end(as_of: Column, width: int = 300) -> Column:
    """End (seconds) of the last whole bucket (start, end] at `as_of`."""
    return F.floor(F.unix_seconds(as_of) / width) * width


def epoch_instant(number: Column) -> Column:
    """Seconds, or milliseconds from 1e11 on, as an instant."""
    return F.when(F.abs(number) >= 100_000_000_000, F.timestamp_millis(number.cast("long"))).otherwise(F.timestamp_seconds(number))


# The published rational Chebyshev coefficients of erf and erfc (Cody 1969) for |x| to 0.46875, to 4 and beyond.
ERF_NEAR = ((3.16112374387056560, 113.864154151050156, 377.485237685302021, 3209.37758913846947, 0.185777706184603153), (23.6012909523441209, 244.024637934444173, 1282.61652607737228, 2844.23683343917062))
ERFC_MIDDLE = (
    (0.564188496988670089, 8.88314979438837594, 66.1191906371416295, 298.635138197400131, 881.952221241769090, 1712.04761263407058, 2051.07837782607147, 1230.33935479799725, 2.15311535474403846e-8),
    (15.7449261107098347, 117.693950891312499, 537.181101862009858, 1621.38957456669019, 3290.79923573345963, 4362.61909014324716, 3439.36767414372164, 1230.33935480374942),
)
ERFC_FAR = ((0.305326634961232344, 0.360344899949804439, 0.125781726111229246, 0.0160837851487422766, 6.58749161529837803e-4, 0.0163153871373020978), (2.56852019228982242, 1.87295284992346725, 0.527905102951428412, 0.0605183413124413191, 2.33520497626869185e-3))


def _ratio(x, top, bottom):
    """The rational function in `x` of one range, by Horner's rule; works on Columns and on SQL text alike."""
    a, b = top[-1] * x, x
    for p, q in zip(top[:-2], bottom[:-1]):
        a, b = (a + p) * x, (b + q) * x
    return (a + top[-2]) / (b + bottom[-1])


def two_sided_tail(z: Column | str) -> Column:
    """P(|N| >= |z|): the complementary error function, which Spark lacks, as an expression of built-in functions."""
    x = F.abs(F.col(z) if isinstance(z, str) else z) / math.sqrt(2)
    square, bell = x * x, F.exp(-x * x)
    far = 1 / F.greatest(square, F.lit(1.0))
    return F.when(x <= 0.46875, 1 - x * _ratio(square, *ERF_NEAR)).when(x <= 4, bell * _ratio(x, *ERFC_MIDDLE)).otherwise(bell / F.greatest(x, F.lit(1.0)) * (1 / math.sqrt(math.pi) - far * _ratio(far, *ERFC_FAR)))


# The words that no search or match counts as terms.
STOP_WORDS = (
    "a", "an", "and", "are", "at", "be", "by", "did", "do", "does", "for", "from", "happen", "in", "is", "market", "no", "of", "on", "or", "the", "to", "was", "were", "what", "when", "where", "which", "who", "will", "win", "wins", "with", "yes",
)


def terms(text: Column) -> Column:
    """Distinct terms: runs of [a-z0-9] with inner _ or -, in lower case, three characters or more, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9_-]*"), 0)
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS)))


def simple_query(text: Column) -> Column:
    """A search text: parentheses, numbers and punctuation taken out, blanks joined."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)", " "), r"\b[0-9][0-9,.%]*", " "), r"[^A-Za-z ]", " ")
    return F.lower(F.trim(F.regexp_replace(plain, r" +", " ")))


def lead_hours(shock: Column, news: Column) -> Column:
    return (F.unix_micros(news) - F.unix_micros(shock)) / 3_600_000_000


def hash_share(*parts: Column) -> Column:
    """A number in [0, 1) from the first 8 bytes of a SHA-256 over the parts: the same draw everywhere."""
    digest = F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
    return F.conv(digest, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, default port and fragment dropped, query sorted; other schemes give ''."""
    scheme, host, path, query = (F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", i) for i in (1, 2, 3, 4))
    low = F.lower(scheme)
    bare = F.when(low == "http", F.regexp_replace(F.lower(host), ":80$", "")).otherwise(F.regexp_replace(F.lower(host), ":443$", ""))
    ordered = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: x != "")), "&")
    return F.when(low.isin("http", "https"), F.concat(low, F.lit("://"), bare, F.when(path == "", "/").otherwise(path), F.when(ordered == "", "").otherwise(F.concat(F.lit("?"), ordered)))).otherwise("")


def abi_word(data: Column, i: int) -> Column:
    """The i-th 32-byte word of hex call data, null where the data is too short or not hex."""
    word = F.substring(data, 3 + 64 * i, 64)
    return F.when(data.rlike("^0x([0-9a-fA-F]{64})+$") & (F.length(word) == 64), F.lower(word))


def topic_address(topic: Column) -> Column:
    """The address in a 32-byte topic; null unless the twelve bytes before it are zero."""
    return F.when(F.lower(topic).rlike("^0x0{24}[0-9a-f]{40}$"), F.concat(F.lit("0x"), F.substring(F.lower(topic), 27, 40)))


def evm_addresses(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("0x[0-9a-fA-F]{40}(?![0-9a-fA-F])"), 0), F.lower)))


def level_order_ok(bids: Column, asks: Column) -> Column:
    """Bids strictly fall, asks strictly rise, the best bid is below the best ask."""
    def strict(levels, falling):
        steps = F.sequence(F.lit(1), F.size(levels) - 1)
        return (F.size(levels) < 2) | F.forall(steps, lambda i: (F.get(levels, i - 1)["price"] > F.get(levels, i)["price"]) if falling else (F.get(levels, i - 1)["price"] < F.get(levels, i)["price"]))

    apart = (F.size(bids) == 0) | (F.size(asks) == 0) | (F.get(bids, F.lit(0))["price"] < F.get(asks, F.lit(0))["price"])
    return strict(bids, True) & strict(asks, False) & apart


def depth(levels: Column, top: int = 5) -> Column:
    return F.aggregate(F.slice(levels, 1, top), F.lit(0.0), lambda a, x: a + x["size"])


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


# The alphabets, generators and checksum constants of the public address standards.
_BECH = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def _bech32_ok(text: str) -> bool:
    """A main-net witness address: version 0 by Bech32 with 20 or 32 bytes, versions 1 to 16 by Bech32m with 2 to 40."""
    if text.lower() != text and text.upper() != text or not 14 <= len(text) <= 90:
        return False
    prefix, _, body = text.lower().rpartition("1")
    if prefix != "bc" or len(body) < 8 or any(c not in _BECH for c in body):
        return False
    values = [_BECH.index(c) for c in body]
    check = 1
    for v in [*[ord(c) >> 5 for c in prefix], 0, *[ord(c) & 31 for c in prefix], *values]:
        high, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            check ^= g if high >> i & 1 else 0
    version, program = values[0], values[1:-6]
    size, spare = divmod(5 * len(program), 8)
    padded = spare < 5 and not (program and program[-1] & (1 << spare) - 1)
    return version <= 16 and padded and (check == 1 and size in (20, 32) if version == 0 else check == 0x2BC830A3 and 2 <= size <= 40)


def _base58_ok(text: str) -> bool:
    """A main-net address of version 0 or 5 with its checksum."""
    from hashlib import sha256

    if not 26 <= len(text) <= 35 or text[0] not in "13" or any(c not in _BASE58 for c in text):
        return False
    number = 0
    for c in text:
        number = number * 58 + _BASE58.index(c)
    if number >= 1 << 200:
        return False
    raw = number.to_bytes(25, "big")
    zeros = len(text) - len(text.lstrip("1"))
    return raw[0] in (0, 5) and zeros == len(raw) - len(raw.lstrip(b"\0")) and sha256(sha256(raw[:21]).digest()).digest()[:4] == raw[21:]


def _address_ok(text: str | None) -> bool | None:
    return None if text is None else _bech32_ok(text) if text.lower().startswith("bc1") else _base58_ok(text)


@F.arrow_udf(T.BooleanType())
def bitcoin_address_ok(address: pa.Array) -> pa.Array:
    """Whether a Bech32, Bech32m or Base58Check address has a right checksum."""
    return pa.array([_address_ok(x) for x in address.to_pylist()], pa.bool_())
