"""Format-preserving pseudonyms for personal data, in native expressions.

Values are found by pattern and validated; each valid one is replaced by a keyed permutation of itself
within its format, so equal values keep one pseudonym in all documents and different values different
ones. The permutation is a Feistel network over two parts of the value, each in turn shifted by a
keyed hash (SHA-256) of the other:

- payment cards (13 to 19 digits, Luhn): the digits but the last, which is computed anew; so the pseudonym
  is valid too. Digits may be grouped by single blanks or hyphens, which stay.
  Where other numbers stand beside a card, the valid runs of groups count from the left,
  if they are unbroken or grouped as cards are (number lists have valid runs by chance).
- telephone numbers of the North American plan, with +1: area, exchange and line, each in its range. With
  `any_phone`, also numbers of that shape whose area or exchange the plan does not give out (below 200): people write
  such numbers too, and each stays below or above 200, so no number of one kind becomes one of the other.
- IPv4 addresses: the 32 bits (not after a letter, as in version numbers). Dates (YYYY-MM-DD, valid, 1800 to 2199): the days of these 400 years.
- e-mail addresses: letters and digits of the local part, each within its own kind; the domain stays.
- access keys (AKIA or ASIA and 16 signs): the signs after the prefix.
- secrets assigned by token, password, key or secret: letters within a to f and the digits within hex
  digits where the value is hexadecimal, else each within its own kind.

The shift of a text of any length is taken from blocks of a stream: a hash of the other part, hashed again with the
block's number. So the work is linear in the value; and no pattern repeats a group without bound, which Java would match by
recursion.

Invalid look-alikes and all other text stay as they are. Nulls stay null; empty texts and empty tables
stay empty. Texts of any length are treated whole. Repeated values and rows get equal pseudonyms. All other columns
pass through; helper columns are never added to the result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Set a secret of your own in production; this one only makes results repeatable.
DEFAULT_KEY = "tidemark"
ROUNDS = 8
#: Digits of a card: unbroken, in fours, as 4-6-4 or 4-6-5, or grouped in any way where no other number stands beside it.
CARDS = (
    r"(?<![0-9])[0-9]{13,19}(?![0-9])",
    r"(?<![0-9])[0-9]{4}(?:[ \-][0-9]{4}){3,18}(?:[ \-][0-9]{3})?(?![0-9])",
    r"(?<![0-9])[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{4,5}(?![0-9])",
    r"(?<![0-9])(?<![0-9][ \-])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9]|[ \-][0-9])",
)
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?=[A-Za-z0-9\-])[A-Za-z0-9.\-]*[A-Za-z0-9\-]\.[A-Za-z]{2,}",
    "secret": r"(?i:\b(?:api[_-]?key|secret|password|token)\s*+[=:]\s*+\"?)[A-Za-z0-9_\-]{8,}",
    "access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "phone": r"\+1[ \-.]?\(?[2-9][0-9]{2}\)?[ \-.]?[2-9][0-9]{2}[ \-.]?[0-9]{4}(?![0-9])",
    "ip": r"(?<![A-Za-z0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9\-])(?:1[89]|2[01])[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9\-])",
    "card": "|".join(CARDS),
}
#: How a card that stands among other numbers is grouped, and how many groups it then has.
GROUPED = r"^(?:[0-9]{13,19}|[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{4,5})$"
GROUPS = (5, 4, 3, 1)
#: Without any of these a text holds nothing personal that the patterns know.
SIGNS = r"[0-9@]|(?i:key|secret|password|token)|AKIA|ASIA"
#: The same shape with any digits.
ANY_PHONE = PATTERNS["phone"].replace("[2-9][0-9]{2}", "[0-9]{3}")
#: Fixed values of the formats.
DAYS_OF_400_YEARS, DAY_PARTS, FIRST_DAY = 146097, (189, 773), "1800-01-01"
PLAN_FROM = 200  # the least area and exchange that the plan gives out


def keyed(key: str, kind: str, round_: Column, value: Column) -> Column:
    """A keyed hash as a hex string of 64 digits."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), value.cast("string")), 256)


def shift_of(key: str, kind: str, round_: Column, value: Column) -> Column:
    """60 bits of the keyed hash as a non-negative long."""
    return F.conv(F.substring(keyed(key, kind, round_, value), 1, 15), 16, 10).cast("long")


def permute_number(value: Column, parts: tuple[Column, Column], key: str, kind: str) -> Column:
    """A permutation of 0 .. a * b - 1 for parts (a, b), up to 2 ** 62."""
    a, b = (p.cast("long") for p in parts)
    start = F.struct(F.floor(value / b).cast("long").alias("x"), (value % b).alias("y"))
    start = F.struct(F.expr("0L").alias("i"), start["x"].alias("x"), start["y"].alias("y"))

    def turn(s: Column, r: Column) -> Column:
        x = F.when(r % 2 == 0, F.pmod(s["x"] + shift_of(key, kind, r, s["y"]) % a, a)).otherwise(s["x"])
        y = F.when(r % 2 == 1, F.pmod(s["y"] + shift_of(key, kind, r, s["x"]) % b, b)).otherwise(s["y"])
        return F.struct(s["i"].alias("i"), x.alias("x"), y.alias("y"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["x"] * b + s["y"])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shift_char(c: Column, by: Column, hexadecimal: Column) -> Column:
    """One letter or digit moved on within its kind; other characters stay."""
    code = F.ascii(c)
    within = lambda first, last: (code >= ord(first)) & (code <= ord(last))
    turned = lambda first, n: F.chr(F.pmod(code - ord(first) + by, F.lit(n)) + ord(first))
    # a hexadecimal value's digits and letters are one kind of sixteen
    place = F.when(code <= ord("9"), code - ord("0")).otherwise(code.bitwiseAND(F.lit(31)) + 9)
    digits = F.when(hexadecimal == "A", F.lit("0123456789ABCDEF")).otherwise(F.lit("0123456789abcdef"))
    in_hex = F.substring(digits, F.pmod(place + by, F.lit(16)).cast("int") + 1, F.lit(1))
    return F.when(hexadecimal != "", in_hex).when(within("0", "9"), turned("0", 10)).when(within("a", "z"), turned("a", 26)).when(within("A", "Z"), turned("A", 26)).otherwise(c)


#: Characters that a block of the stream shifts, with four hex digits each.
BLOCK = 16


def permute_text(value: Column, key: str, kind: str, hexadecimal: Column) -> Column:
    """A permutation of the texts of one shape (which characters are of which kind), for any length. hexadecimal is
    a or A where the whole value is made of such digits, else empty."""
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("x"), F.substring(value, half + 1, F.length(value)).alias("y"))

    def block(digest: Column, j: Column) -> Column:
        number = lambda h: F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda k: F.conv(F.substring(h, k * 4 + 1, F.lit(4)), 16, 10).cast("int"))
        return bound(F.sha2(F.concat_ws("|", digest, j.cast("string")), 256), number)

    def shifted(text: Column, other: Column, r: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(F.length(text) / BLOCK).cast("int"))
        stream = bound(keyed(key, kind, r, other), lambda d: F.flatten(F.transform(blocks, lambda j: block(d, j))))
        signs = F.filter(F.split(text, ""), lambda c: c != "")
        # the longer of the two goes on with nulls, which are left out of the text
        moved = F.zip_with(signs, stream, lambda c, by: F.when(c.isNotNull(), shift_char(c, by, hexadecimal)))
        return F.array_join(moved, "")

    def turn(s: Column, r: Column) -> Column:
        return F.struct(F.when(r % 2 == 0, shifted(s["x"], s["y"], r)).otherwise(s["x"]).alias("x"), F.when(r % 2 == 1, shifted(s["y"], s["x"], r)).otherwise(s["y"]).alias("y"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["x"], s["y"]))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(payload: Column) -> Column:
    """The Luhn sum of digits that a check digit is still to follow."""
    n = F.length(payload)
    doubled = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(payload, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d))


def valid_card(value: Column) -> Column:
    d = digits_of(value)
    return (luhn_sum(F.substring(d, F.lit(1), F.length(d) - 1)) + F.substring(d, -1, 1).cast("int")) % 10 == 0


def refill(shape: Column, digits: Column) -> Column:
    """Puts digits, in order, in the places of a text's digits."""
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["text"], F.when(is_digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("text"), F.when(is_digit, s["at"] + 1).otherwise(s["at"]).alias("at"))

    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), start, step, lambda s: s["text"])


def card(value: Column, key: str) -> Column:
    d = digits_of(value)
    payload = F.substring(d, F.lit(1), F.length(d) - 1)
    low = F.floor(F.length(payload) / 2).cast("int")
    size = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("long")  # noqa: E731  ten to the power n
    moved = permute_number(payload.cast("long"), (size(F.length(payload) - low), size(low)), key, "card")
    new = F.lpad(moved.cast("string"), F.length(payload), "0")
    return F.when(valid_card(value), refill(value, F.concat(new, F.pmod(-luhn_sum(new), F.lit(10)).cast("string")))).otherwise(value)


def cards(value: Column, key: str) -> Column:
    """The pseudonym of a card; in a run that is none as a whole, from the left each run of its groups that is one,
    in a card's own grouping, is replaced. A run has 20 groups at most."""

    def found(part: Column) -> Column:
        run = lambda i, n: F.regexp_replace(F.array_join(F.slice(part, i, F.lit(n)), ""), "[ \\-]$", "")

        def step(s: Column, i: Column) -> Column:
            tried = F.array(*[F.struct(F.lit(n).alias("n"), run(i, n).alias("card")) for n in GROUPS])
            valid = F.filter(tried, lambda t: (i + t["n"] - 1 <= F.size(part)) & t["card"].rlike(GROUPED) & valid_card(t["card"]))
            own = F.get(part, i - 1)

            def put(t: Column) -> Column:
                sign = F.regexp_extract(F.get(part, i + t["n"] - 2), "[ \\-]$", 0)
                new = F.struct(F.concat(s["text"], card(t["card"], key), sign).alias("text"), (i + t["n"]).alias("next"))
                return F.when(t.isNull(), F.struct(F.concat(s["text"], own).alias("text"), (i + 1).alias("next"))).otherwise(new)

            return F.when(i < s["next"], s).otherwise(bound(F.get(valid, F.lit(0)), put))

        start = F.struct(F.lit("").alias("text"), F.lit(1).alias("next"))
        return F.aggregate(F.sequence(F.lit(1), F.size(part)), start, step, lambda s: s["text"])

    return F.when(valid_card(value) & (F.length(digits_of(value)) <= 19), card(value, key)).otherwise(bound(F.regexp_extract_all(value, F.lit("[0-9]+[ \\-]?"), 0), found))


def phone(value: Column, key: str) -> Column:
    d = F.substring(digits_of(value), 2, 10)
    area, exchange = F.substring(d, 1, 3).cast("long"), F.substring(d, 4, 3).cast("long")
    least = lambda x: F.when(x < PLAN_FROM, 0).otherwise(PLAN_FROM)
    exchanges = F.when(exchange < PLAN_FROM, PLAN_FROM).otherwise(1000 - PLAN_FROM)
    number = ((area - least(area)) * exchanges + exchange - least(exchange)) * 10000 + F.substring(d, 7, 4).cast("long")
    # areas * exchanges * 10000 lines is a square for each of the four kinds: 80000, 40000 (twice) and 20000
    low = F.when(area < PLAN_FROM, 2).otherwise(1) * F.when(exchange < PLAN_FROM, 2).otherwise(1)
    part = F.floor(F.lit(80_000) / low)
    moved = permute_number(number, (part, part), key, "phone")
    head = F.floor(moved / 10000).cast("long")
    three = lambda x: F.lpad(x.cast("string"), 3, "0")
    new = F.concat(three(F.floor(head / exchanges) + least(area)), three(head % exchanges + least(exchange)), F.lpad((moved % 10000).cast("string"), 4, "0"))
    return refill(value, F.concat(F.lit("1"), new))


def ip(value: Column, key: str) -> Column:
    part = F.split(value, r"\.")
    number = reduce(lambda n, k: n * 256 + F.get(part, F.lit(k)).cast("long"), range(4), F.lit(0).cast("long"))
    moved = permute_number(number, (F.lit(1 << 16), F.lit(1 << 16)), key, "ip")
    return F.concat_ws(".", *[F.shiftright(moved, 8 * k).bitwiseAND(F.lit(255).cast("long")).cast("string") for k in (3, 2, 1, 0)])


def date(value: Column, key: str) -> Column:
    day = F.datediff(F.try_to_date(value, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date")).cast("long")
    moved = permute_number(day, (F.lit(DAY_PARTS[0]), F.lit(DAY_PARTS[1])), key, "date")
    return F.coalesce(F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), moved.cast("int")), "yyyy-MM-dd"), value)


def email(value: Column, key: str) -> Column:
    at = F.instr(value, "@")
    return F.concat(permute_text(F.substring(value, F.lit(1), at - 1), key, "email", F.lit("")), F.substring(value, at, F.length(value)))


def secret(value: Column, key: str) -> Column:
    head = F.regexp_extract(value, r"^[A-Za-z_\-]+\s*+[=:]\s*+\"?", 0)
    body = F.substring(value, F.length(head) + 1, F.length(value))
    hexadecimal = F.when(body.rlike("^[0-9a-f]+$"), F.lit("a")).when(body.rlike("^[0-9A-F]+$"), F.lit("A")).otherwise(F.lit(""))
    return F.concat(head, bound(hexadecimal, lambda h: permute_text(body, key, "secret", h)))


def access_key(value: Column, key: str) -> Column:
    return F.concat(F.substring(value, 1, 4), permute_text(F.substring(value, F.lit(5), F.length(value)), key, "access key", F.lit("")))


def patterns(any_phone: bool = False) -> dict[str, str]:
    return PATTERNS | {"phone": ANY_PHONE} if any_phone else PATTERNS


def pseudonym(value: Column, key: str = DEFAULT_KEY, any_phone: bool = False) -> Column:
    """The pseudonym of one found value, by the first format that it has."""
    kinds = {"email": email, "secret": secret, "access_key": access_key, "phone": phone, "ip": ip, "date": date, "card": cards}
    out, shapes = value, patterns(any_phone)
    for kind in reversed(shapes):
        out = F.when(value.rlike(f"^(?:{shapes[kind]})$"), kinds[kind](value, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str = DEFAULT_KEY, text_col: str = "text", any_phone: bool = False) -> DataFrame:
    """The rows with their texts pseudonymised; all other columns stay. No shuffle."""
    text, found_by = F.col(f"`{text_col}`"), "|".join(patterns(any_phone).values())
    between = F.split(text, found_by, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(found_by), 0), lambda v: pseudonym(v, key, any_phone))
    # one more text between than values: each value after the text before it
    joined = F.array_join(F.flatten(F.zip_with(between, found, lambda t, v: F.array(F.coalesce(t, F.lit("")), F.coalesce(v, F.lit(""))))), "")
    return docs.withColumn(text_col, F.when(text.rlike(SIGNS) & text.rlike(found_by), joined).otherwise(text))
