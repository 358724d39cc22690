"""Format-preserving Feistel pseudonyms for personal numbers, dates, addresses of mail and network; SQL functions only.

A value is a list of symbols, each with its own radix. Its halves take turns: each symbol of one half is shifted,
modulo its radix, by a keyed SHA-256 of the other half, the round and the symbol's place. So the result is a keyed
permutation of all values of the format, and equal values have equal pseudonyms in every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

ROUNDS = 8
#: the session's setting that holds the secret key, and what stands in for it in tests and benchmarks, where it is unset
SETTING, EXAMPLE_KEY = "stylometra.pseudonyms.key", "stylometra example key"
# The forms of personal data. Each is validated after it is found.
EMAIL = r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"{OCTET}(?:\.{OCTET}){{3}}"
YEAR, MONTH, DAY = r"(?:19|20)[0-9]{2}", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12][0-9]|3[01])"
DATES = {"yyyy-MM-dd": rf"{YEAR}-{MONTH}-{DAY}", "yyyy/MM/dd": rf"{YEAR}/{MONTH}/{DAY}", "dd.MM.yyyy": rf"{DAY}\.{MONTH}\.{YEAR}", "MM/dd/yyyy": rf"{MONTH}/{DAY}/{YEAR}"}
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
PHONE = r"(?:\+?1[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[ .-]?[0-9]{4}|\+1[ .-]?[0-9]{3}[ .-][0-9]{3}[ .-]?[0-9]{4}|(?:1[ .-])?[2-9][0-9]{2}[ .-][2-9][0-9]{2}[ .-][0-9]{4}"
CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
AFTER, BEFORE = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
NUMBERS = rf"(?=[0-9(+]){AFTER}(?:{'|'.join(DATES.values())}|{IP}|{SSN}|{PHONE}|{CARD}){BEFORE}"
FOUND = rf"{AFTER}(?:{EMAIL}|{'|'.join(DATES.values())}|{IP}|{SSN}|{PHONE}|{CARD}){BEFORE}"
#: what may begin at one place besides mail, in this order; a card's digits from most to fewest
KINDS = (rf"(?:{'|'.join(DATES.values())})", IP, SSN, rf"(?:{PHONE})", *(rf"[0-9](?:[ -]?[0-9]){{{n - 1}}}" for n in range(19, 12, -1)))
#: characters of the longest number and of what follows it
WINDOW = 48
#: after a character that no kind contains
CUT = r"(?<=[^\p{L}\p{N}._%+@() /-])"
#: days from 1900-01-01 to 2099-12-31, as two symbols
DAYS = (17, 4297)

def secret(spark: SparkSession) -> str:
    """The key of the session; whoever knows it can turn pseudonyms back, so it belongs in no source."""
    return spark.conf.get(SETTING, EXAMPLE_KEY)


long = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")


def feistel(symbols: Column, radices: Column, kind: str, key: str) -> Column:
    """The permuted symbols (array<long>); a list of one symbol is shifted by the key alone."""
    half = F.floor(F.size(symbols) / 2).cast("int")
    cut = lambda x, first: F.slice(x, 1, half) if first else F.slice(x, half + 1, F.size(x) - half)
    begin = F.struct(cut(symbols, True).alias("a"), cut(radices, True).alias("ra"), cut(symbols, False).alias("b"), cut(radices, False).alias("rb"))

    def turn(s: Column, i: Column) -> Column:
        seen = F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), F.array_join(s["a"].cast("array<string>"), ","))

        def shifted(x: Column, j: Column) -> Column:
            digest = F.sha2(F.concat(seen, F.lit("|"), j.cast("string")).cast("binary"), 256)
            return F.pmod(x + F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.get(s["rb"], j))

        return F.struct(F.transform(s["b"], shifted).alias("a"), s["rb"].alias("ra"), s["a"].alias("b"), s["ra"].alias("rb"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, turn, lambda s: F.concat(s["a"], s["b"]))


def numbers(text: Column) -> Column:
    """The digits of text as array<long>."""
    return F.split(F.regexp_replace(text, "[^0-9]", ""), "").cast("array<long>")


def filled(text: Column, digits: Column) -> Column:
    """text with its digits replaced by others, in order."""
    place = lambda i: F.length(F.regexp_replace(F.substring(text, F.lit(1), i + 1), "[^0-9]", "")) - 1
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(c.between("0", "9"), F.get(digits, place(i)).cast("string")).otherwise(c)), "")


def luhn(digits: Column) -> Column:
    """The check digit after these digits."""
    n = F.size(digits)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), long(0), lambda s, i: s + F.when(F.pmod(n - i, F.lit(2)) == 1, F.pmod(F.get(digits, i) * 2, F.lit(10)) + F.floor(F.get(digits, i) / 5)).otherwise(F.get(digits, i)))
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("long")


def same(n: Column, radix: int) -> Column:
    return F.array_repeat(long(radix), n)


def _card(m: Column, key: str) -> Column:
    digits = numbers(m)
    payload = F.slice(digits, 1, F.size(digits) - 1)
    fresh = feistel(payload, same(F.size(payload), 10), "card", key)
    return F.when(luhn(payload) == F.element_at(digits, -1), filled(m, F.concat(fresh, F.array(luhn(fresh)))))


def _phone(m: Column, key: str) -> Column:
    digits = numbers(m)
    last = F.slice(digits, F.size(digits) - 9, 10)
    # a first digit of area or exchange stays among 0 and 1, or among 2 to 9
    low = lambda j: F.when(j.isin(0, 3) & (F.get(last, j) >= 2), long(2)).otherwise(long(0))
    radix = lambda j: F.when(j.isin(0, 3), F.when(F.get(last, j) >= 2, 8).otherwise(2)).otherwise(10).cast("long")
    fresh = feistel(F.transform(last, lambda x, j: x - low(j)), F.transform(last, lambda x, j: radix(j)), "phone", key)
    return filled(m, F.concat(F.slice(digits, 1, F.size(digits) - 10), F.transform(fresh, lambda x, j: x + low(j))))


def _ssn(m: Column, key: str) -> Column:
    p = F.split(m, "-").cast("array<long>")
    area, group, serial = (F.get(p, F.lit(k)) for k in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    fresh = feistel(F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1), F.array(long(898), long(99), long(9999)), "ssn", key)
    index = F.get(fresh, F.lit(0)) + 1
    padded = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.when(valid, F.concat_ws("-", padded(index + F.when(index >= 666, 1).otherwise(0), 3), padded(F.get(fresh, F.lit(1)) + 1, 2), padded(F.get(fresh, F.lit(2)) + 1, 4)))


def _ip(m: Column, key: str) -> Column:
    p = F.split(m, r"\.").cast("array<long>")
    return F.array_join(feistel(p, same(F.size(p), 256), "ip", key).cast("array<string>"), ".")


def _date(m: Column, layout: str, key: str) -> Column:
    day = F.try_to_timestamp(m, F.lit(layout)).cast("date")
    n = F.date_diff(day, F.lit("1900-01-01").cast("date")).cast("long")
    fresh = feistel(F.array(F.floor(n / DAYS[1]).cast("long"), F.pmod(n, long(DAYS[1]))), F.array(*map(long, DAYS)), "date", key)
    days = F.get(fresh, F.lit(0)) * DAYS[1] + F.get(fresh, F.lit(1))
    return F.when(day.isNotNull(), F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), days.cast("int")), layout))


def _email(m: Column, key: str) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    chars = F.split(F.lower(local), "")
    digit, letter = (lambda c: c.between("0", "9")), (lambda c: c.between("a", "z"))
    symbols = F.transform(chars, lambda c: F.when(digit(c), F.ascii(c) - 48).when(letter(c), F.ascii(c) - 97).otherwise(0).cast("long"))
    radices = F.transform(chars, lambda c: F.when(digit(c), 10).when(letter(c), 26).otherwise(1).cast("long"))
    fresh = feistel(symbols, radices, "email", key)

    def shown(c: Column, i: Column) -> Column:
        x = F.get(fresh, i)
        return F.when(digit(c), x.cast("string")).when(letter(F.lower(c)), F.when(c.between("A", "Z"), F.char(x + 65)).otherwise(F.char(x + 97))).otherwise(c)

    return F.concat(F.array_join(F.transform(F.split(local, ""), shown), ""), F.lit("@"), domain)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one found string; null where validation rejects it."""
    is_ = lambda pattern: m.rlike(rf"^(?:{pattern})$")
    out = F.when(is_(EMAIL), _email(m, key))
    for layout, pattern in DATES.items():
        out = out.when(is_(pattern), _date(m, layout, key))
    return out.when(is_(IP), _ip(m, key)).when(is_(SSN), _ssn(m, key)).when(is_(PHONE), _phone(m, key)).when(is_(CARD), _card(m, key))


def searched(text: Column, key: str) -> Column:
    """text with its pseudonyms and how many strings changed (struct of out and n), searched place by place.

    At each place where a string may begin, the first kind that validation accepts is taken, a card with as many digits
    as it can have; else the search goes on at the next place, inside of what was rejected.
    """
    begins = rf"(?={FOUND})"
    pieces = F.split(text, begins, -1)
    mails, windows = (F.regexp_extract_all(text, F.lit(rf"{begins}(?=({EMAIL}{BEFORE})?)(?=([\s\S]{{1,{WINDOW}}}))"), F.lit(k)) for k in (1, 2))

    def accepted(mail: Column, window: Column) -> Column:
        tried = F.filter(F.array(mail, *(F.regexp_extract(window, rf"^({kind}){BEFORE}", 1) for kind in KINDS)), lambda m: m != "")
        return F.get(F.filter(F.transform(tried, lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new"))), lambda x: x["new"].isNotNull()), F.lit(0))

    def step(s: Column, x: Column) -> Column:
        piece, best = x["piece"], x["best"]
        taken = (s["left"] == 0) & best.isNotNull()
        skip = F.when(taken, F.length(best["old"])).otherwise(s["left"])
        rest = F.substring(piece, skip + 1, F.length(piece))
        return F.struct(
            F.concat(s["out"], F.when(taken, best["new"]).otherwise(F.lit("")), rest).alias("out"),
            F.greatest(skip - F.length(piece), F.lit(0)).alias("left"),
            (s["n"] + F.when(taken & (best["old"] != best["new"]), 1).otherwise(0)).alias("n"),
        )

    # the text before the first place is a piece of its own, unless it is empty
    found = F.zip_with(mails, windows, lambda mail, window: F.struct(mail.alias("mail"), window.alias("window")))
    lead = F.array_repeat(F.struct(F.lit("").alias("mail"), F.lit("").alias("window")), F.size(pieces) - F.size(windows))
    places = F.zip_with(pieces, F.concat(lead, found), lambda piece, x: F.struct(piece.alias("piece"), F.when(x["window"] != "", accepted(x["mail"], x["window"])).alias("best")))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("left"), long(0).alias("n"))
    return F.aggregate(places, begin, step, lambda s: F.struct(s["out"], s["n"]))


def pseudonymize(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """df with all personal data of text_col replaced, and n_replaced (strings that changed).

    Luhn-valid card numbers keep a valid check digit, phone numbers keep valid area and exchange codes valid, dates (1900 to 2099,
    four layouts) stay dates, social security numbers and IPv4 addresses stay valid, mail addresses keep their domain
    and the classes of characters. Layout and separators stay. Whole texts of any length are searched; no shuffle. A text
    in which validation rejects a string is searched again place by place, also inside of that string.
    Null text: null, 0. Empty text: empty, 0. Repeated rows get equal results. All other columns stay; an own column
    n_replaced is replaced.
    """
    text = F.col(f"`{text_col}`")
    mail = text.contains("@")
    # without a sign of mail only numbers can match, which begin at few characters
    found = F.when(mail, F.regexp_extract_all(text, F.lit(FOUND), F.lit(0))).when(text.rlike("[0-9]"), F.regexp_extract_all(text, F.lit(NUMBERS), F.lit(0)))
    old, new, again = (next(x for x in (f"_{name}{'_' * k}" for k in range(len(df.columns) + 1)) if x not in df.columns) for name in ("found", "fresh", "again"))
    rows = df.withColumn(old, found)
    rows = rows.withColumn(new, F.when(F.size(old) > 0, F.transform(old, lambda m: pseudonym(m, key))))
    rows = rows.withColumn(again, F.when(F.exists(new, lambda m: m.isNull()), F.transform(F.split(text, CUT, -1), lambda t: F.when(t.rlike(FOUND), searched(t, key)).otherwise(F.struct(t.alias("out"), long(0).alias("n"))))))
    joined = F.array_join(F.transform(F.when(mail, F.split(text, FOUND, -1)).otherwise(F.split(text, NUMBERS, -1)), lambda g, i: F.concat(g, F.coalesce(F.get(new, i), F.lit("")))), "")
    changed = F.aggregate(F.zip_with(old, new, lambda x, y: (x != y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    retold, recount = F.array_join(F.transform(again, lambda x: x["out"]), ""), F.aggregate(again, long(0), lambda s, x: s + x["n"])
    n = F.when(F.col(again).isNotNull(), recount).when(F.col(new).isNotNull(), changed).otherwise(F.lit(0).cast("long"))
    return rows.withColumns({"n_replaced": n, text_col: F.when(F.col(again).isNotNull(), retold).when(F.col(new).isNotNull(), joined).otherwise(text)}).drop(old, new, again)


def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their personal data replaced."""
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), secret(spark))
