"""Checks of an edit that compare words in their context: swapped numbers, flipped negations, changed roles, new names.

Every check is a chain of columns in the row of a pair of texts: no shuffle, and rows of one id stay apart. What a later
step reads more than once goes through a generator (`once`), as projections would be merged and evaluated again for every
element otherwise. Null texts count as empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import once

# Particles of negation, words after which a particle is part of an idiom, the joints of a list of names,
# and how many names must change their case.
NEGATIONS = ("не", "ни")
NEGATION_IDIOMS = ("просто", "только", "столько", "так", "менее", "более", "раз", "всегда", "совсем", "очень", "то", "же", "бы", "ли")
JOINTS = r"\s*(?:,\s*|\s(?:и|или|либо|да)\s+)"
LEAST_ROLES = 2
# Words that are no context of a number: function words, words of counting and their stems.
FUNCTION_WORDS = (
    "в во на по до от из за со ко об обо при для без под над про через после перед между около у "
    "и а но или либо же ли бы не ни то это этот эта эти тот та те так как что чем тоже также "
    "еще уже всего лишь только его ее их он оно она они мы вы ты"
).split()
COUNTING = "тыс млн млрд трлн шт чел раз раза".split()
COUNTING_STEMS = "тысяч миллион миллиард триллион штук человек".split()
# Units by abbreviation, by form, and by stem (longer stems first).
UNIT_ABBREVIATIONS = {
    "мс": "миллисекунд", "см": "сантиметр", "мм": "миллиметр", "км": "километр", "мг": "миллиграмм", "кг": "килограмм", "мл": "миллилитр", "кб": "килобайт",
    "мб": "мегабайт", "гб": "гигабайт", "тб": "терабайт", "квт": "киловатт", "кгц": "килогерц", "мгц": "мегагерц", "ггц": "гигагерц", "гц": "герц",
    "мин": "минут", "сек": "секунд", "руб": "рубл", "%": "процент", "₽": "рубл", "$": "доллар", "€": "евро",
}
UNIT_STEMS = (
    "миллисекунд сантиметр миллиметр километр миллиграмм килограмм миллилитр килобайт мегабайт гигабайт терабайт киловатт килогерц мегагерц гигагерц "
    "процент секунд минут грамм литр метр тонн байт вольт ампер ватт герц градус рубл доллар евро недел месяц"
).split()
UNIT_FORMS = {"час": "час часа часов часу часам".split(), "день": "день дня дней дням днях".split(), "год": "год года годов году лет".split(), "сутки": "сутки суток".split()}
# Where parts of a sentence end, and what a number is (groups of digits with blanks, decimals, dates).
PARTS = r"(?iu)[.!?…]+(?=\s|$)|[;\n]|,(?![0-9])|\s(?:и|а|но|или)\s"
NUMBER = r"(?<![\p{L}\p{N}.,])(?:[0-9]{1,3}(?:[ \u00A0\u202F][0-9]{3})+(?![0-9])|[0-9]+)(?:[.,][0-9]+)*"
NUMBER_UNIT = r"(?<![0-9.,])([0-9]+(?:[.,][0-9]+)?)\s?(%|₽|\$|€|\p{L}+)"
# What may stand before the first word of a line, after an opening sign, and after the end of a sentence.
LINE_LEAD = r"(?:^|\n)[^\p{L}\p{N}\n]*(?:[0-9]{1,3}[.)][^\p{L}\p{N}\n]*)?"
STARTS = LINE_LEAD + r"|[:;(«„“\"][^\p{L}\p{N}\n]*|[.!?…]+[^\p{L}\p{N}\n]*"
# Polite forms, and a vowel that other forms of a word lose.
POLITE = "вы вас вам вами ваш ваша ваше ваши вашего вашей вашему вашим вашими ваших вашу вашем".split()
FLEETING = r"\p{L}{2}[ео][бвгджзклмнпрстфхцчшщ]$"
MARK = "\x1e"
STRINGS = "array<string>"


def same_stem(a: Column, b: Column) -> Column:
    """Whether two words are forms of one: equal but for two letters of the shorter one and what follows; short words must be a beginning."""
    short = F.least(F.length(a), F.length(b))
    start = lambda n: F.left(a, n) == F.left(b, n)
    return F.when(short <= 3, start(short) & (F.abs(F.length(a) - F.length(b)) <= 3)).otherwise(start(F.greatest(F.lit(3), short - 2)))


def covered(word: Column, words: Column) -> Column:
    return F.exists(words, lambda other: same_stem(word, other))


def letters(text: Column) -> Column:
    """Runs of letters in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0)), F.lower)


def unit(word: Column) -> Column:
    """The unit that a word in lower case names, null if none."""
    found = F.lit(None).cast("string")
    for stem in reversed(UNIT_STEMS):
        found = F.when(F.startswith(word, F.lit(stem)), stem).otherwise(found)
    for name, forms in UNIT_FORMS.items():
        found = F.when(word.isin(forms), name).otherwise(found)
    for short, name in UNIT_ABBREVIATIONS.items():
        found = F.when(word == short, name).otherwise(found)
    return found


def is_unit(word: Column) -> Column:
    """Whether a word names a unit: one pattern instead of a case for each."""
    forms = [*UNIT_ABBREVIATIONS, *(f for some in UNIT_FORMS.values() for f in some)]
    return word.isin(forms) | word.rlike(f"^(?:{'|'.join(UNIT_STEMS)})")


def context_word(word: Column) -> Column:
    """Whether a word says what a number counts or belongs to."""
    return (F.length(word) >= 2) & ~word.isin(FUNCTION_WORDS) & ~word.isin(COUNTING) & ~word.rlike(f"^(?:{'|'.join(COUNTING_STEMS)})") & ~is_unit(word)


def number_parts(text: Column) -> Column:
    """Parts of sentences with their numbers: array of number, key, words, part, keys. List numbers don't count."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), LINE_LEAD.replace("(?:^|\\n)", "(^|\\n)", 1), "$1")

    def part(piece: Column) -> Column:
        found = F.regexp_extract_all(piece, F.lit(NUMBER), F.lit(0))
        keys = F.transform(found, lambda x: F.replace(F.regexp_replace(x, r"[\s\u00A0\u202F]+", ""), F.lit(","), F.lit(".")))
        whole = F.regexp_replace(F.regexp_extract(piece, r"(?s)[\p{L}\p{N}](?:.*[\p{L}\p{N}])?", 0), r"[\s\u00A0\u202F]+", " ")
        number = F.regexp_replace(F.get(found, F.lit(0)), r"[\s\u00A0\u202F]+", " ")
        return F.struct(number.alias("number"), F.get(keys, F.lit(0)).alias("key"), F.filter(letters(piece), context_word).alias("words"), whole.alias("part"), keys.alias("keys"))

    return F.filter(F.transform(F.split(clean, PARTS), part), lambda x: F.size(x["keys"]) > 0)


def lone_numbers(parts: Column, ordered: Column) -> Column:
    """Of parts those with one number, which the text has only once; `ordered`: all keys of the text, sorted."""
    single = F.filter(ordered, lambda x, i: ~F.coalesce(F.get(ordered, i - 1) == x, F.lit(False)) & ~F.coalesce(F.get(ordered, i + 1) == x, F.lit(False)))
    return F.filter(parts, lambda x: (F.size(x["keys"]) == 1) & F.array_contains(single, x["key"]))


def number_swaps(pairs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """pairs with `swaps`: array of numbers (in the order of the source), was and now (the part of the first one).

    A number has moved to the place of another if none of the words of its own stand by it any more, but words of the
    other's own do; a tie between two places moves nothing. Only closed cycles of moves are swaps: one moved number
    is a paraphrase. Numbers that a text repeats, or that share their part with another, aren't judged.

    Only numbers with a word lost are compared with the others, so an edit costs (changed numbers) x (numbers).
    """
    rows = once(pairs, _b=number_parts(F.col(before)), _a=number_parts(F.col(after)))
    keys = lambda c: F.array_sort(F.flatten(F.transform(c, lambda x: x["keys"])))
    rows = once(rows, _bk=keys(F.col("_b")), _ak=keys(F.col("_a")))
    rows = once(rows, _bl=lone_numbers(F.col("_b"), F.col("_bk")), _al=lone_numbers(F.col("_a"), F.col("_ak")))
    places = F.map_from_arrays(F.transform("_al", lambda x: x["key"]), F.col("_al"))
    rows = once(rows, _at=places)
    both = F.filter(F.transform("_bl", lambda x: F.struct(x["number"].alias("number"), x["key"].alias("key"), x["words"].alias("words"), x["part"].alias("was"), F.try_element_at("_at", x["key"]).alias("now"))), lambda x: x["now"].isNotNull())
    rows = once(rows, _c=both)

    def target(x: Column) -> Column:
        now = x["now"]["words"]

        def option(o: Column) -> Column:
            own = F.filter(x["words"], lambda w: ~covered(w, o["words"]))
            gone = (F.size(own) > 0) & ~F.exists(own, lambda w: covered(w, now))
            taken = F.filter(o["words"], lambda w: ~covered(w, x["words"]) & covered(w, now))
            return F.struct(F.when((o["key"] != x["key"]) & gone, F.size(taken)).otherwise(0).alias("n"), o["key"].alias("key"))

        return F.slice(F.sort_array(F.filter(F.transform("_c", option), lambda o: o["n"] > 0), asc=False), 1, 2)

    changed = F.filter("_c", lambda x: F.exists(x["words"], lambda w: ~covered(w, x["now"]["words"])))
    rows = once(rows, _t=F.transform(changed, lambda x: F.struct(x["number"].alias("number"), x["key"].alias("key"), x["was"].alias("was"), x["now"]["part"].alias("now"), target(x).alias("best"))))
    clear = lambda x: (F.size(x["best"]) == 1) | (F.get(x["best"], F.lit(0))["n"] > F.get(x["best"], F.lit(1))["n"])
    rows = once(rows, _m=F.filter("_t", clear))
    rows = once(rows, _to=F.map_from_arrays(F.transform("_m", lambda x: x["key"]), F.transform("_m", lambda x: F.get(x["best"], F.lit(0))["key"])), _order=F.transform("_m", lambda x: x["key"]))

    def walk(x: Column) -> Column:
        following = lambda seen: F.try_element_at("_to", F.element_at(seen, -1))
        step = lambda seen, _: F.when(following(seen).isNull() | F.array_contains(seen, following(seen)), seen).otherwise(F.concat(seen, F.array(following(seen))))
        return F.aggregate("_m", F.array(x["key"]), step)

    rows = once(rows, _walks=F.transform("_m", lambda x: F.struct(x["key"].alias("key"), x["was"].alias("was"), x["now"].alias("now"), walk(x).alias("cycle"))))
    place = lambda k: F.array_position("_order", k)
    closed = F.filter("_walks", lambda x: (F.try_element_at("_to", F.element_at(x["cycle"], -1)) == x["key"]) & ~F.exists(x["cycle"], lambda k: place(k) < place(x["key"])))
    named = lambda cycle: F.transform(F.filter("_m", lambda m: F.array_contains(cycle, m["key"])), lambda m: m["number"])
    swaps = F.transform(closed, lambda x: F.struct(named(x["cycle"]).alias("numbers"), x["was"].alias("was"), x["now"].alias("now")))
    return rows.select(*pairs.columns, swaps.alias("swaps"))


def negation_flips(pairs: DataFrame, before: str = "before", after: str = "after", particles: tuple = NEGATIONS, idioms: tuple = NEGATION_IDIOMS) -> DataFrame:
    """pairs with `flips`: array of change (gained or lost), particle and word.

    A word has gained a negation if the edited text negates it, and the source has forms of it, none of them negated;
    lost is the same the other way round. Where a sentence stands doesn't matter, and a word that left the text altogether
    is a paraphrase. Words of idioms don't count.
    """
    text = lambda c: letters(F.coalesce(F.col(c), F.lit("")))
    rows = once(pairs, _bw=text(before), _aw=text(after))

    def split(words: str) -> tuple[Column, Column]:
        after_particle = lambda i: F.coalesce(F.get(words, i - 1).isin(*particles), F.lit(False))
        each = F.filter(F.transform(words, lambda w, i: F.struct(F.when(after_particle(i), F.get(words, i - 1)).alias("particle"), w.alias("word"))), lambda x: ~x["word"].isin(*particles))
        return F.array_distinct(F.filter(each, lambda x: x["particle"].isNotNull())), F.array_distinct(F.transform(F.filter(each, lambda x: x["particle"].isNull()), lambda x: x["word"]))

    (bn, bp), (an, ap) = split("_bw"), split("_aw")
    rows = once(rows, _bn=bn, _bp=bp, _an=an, _ap=ap)

    def found(change: str, here: str, there: str, plain: str) -> Column:
        judged = lambda x: ~x["word"].isin(*idioms) & ~F.exists(there, lambda o: same_stem(x["word"], o["word"])) & covered(x["word"], F.col(plain))
        return F.transform(F.filter(here, judged), lambda x: F.struct(F.lit(change).alias("change"), x["particle"].alias("particle"), x["word"].alias("word")))

    return rows.select(*pairs.columns, F.concat(found("gained", "_an", "_bn", "_bp"), found("lost", "_bn", "_an", "_ap")).alias("flips"))


def capitalized(text: Column) -> Column:
    """Words with a capital (no acronyms, no Latin letters): array of word and at_start, where a capital says nothing."""
    found = F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), STARTS, "$0" + MARK), F.lit(rf"{MARK}?\p{{L}}+"), F.lit(0))
    each = F.transform(found, lambda x: F.struct(F.ltrim(x, F.lit(MARK)).alias("word"), F.startswith(x, F.lit(MARK)).alias("at_start")))
    return F.filter(each, lambda x: x["word"].rlike(r"^\p{Lu}\P{Lu}") & ~x["word"].rlike(r"\p{IsLatin}"))


def joined_names(text: Column, a: Column, b: Column) -> Column:
    """Whether two names stand in one list: with a joint between them, in either order."""
    border = r"[\p{L}\p{N}_]"
    pattern = F.concat(F.lit(f"(?<!{border})(?:"), F.lower(a), F.lit(JOINTS), F.lower(b), F.lit("|"), F.lower(b), F.lit(JOINTS), F.lower(a), F.lit(f")(?!{border})"))
    return F.rlike(F.lower(F.coalesce(text, F.lit(""))), pattern)


def role_changes(pairs: DataFrame, before: str = "before", after: str = "after", least: int = LEAST_ROLES) -> DataFrame:
    """pairs with `roles`: array of was and now, names whose case an edit changed; empty if fewer than `least` roles did.

    A name is a word with a capital within a sentence of either text; its forms are all words of its stem. Names of one
    list play one role, so they count once: names that a joint links, directly or through others, are one group.
    """
    rows = once(pairs, _bw=F.array_distinct(capitalized(F.col(before))), _aw=F.array_distinct(capitalized(F.col(after))))
    inner = F.transform(F.filter(F.concat("_bw", "_aw"), lambda x: ~x["at_start"]), lambda x: F.lower(x["word"]))
    rows = once(rows, _n=F.aggregate(F.array_distinct(inner), F.array().cast(STRINGS), lambda seen, x: F.when(covered(x, seen), seen).otherwise(F.concat(seen, F.array(x)))))
    forms = lambda side, name: F.array_distinct(F.transform(F.filter(side, lambda x: same_stem(F.lower(x["word"]), name)), lambda x: x["word"]))
    rows = once(rows, _f=F.transform("_n", lambda n: F.struct(forms("_bw", n).alias("b"), forms("_aw", n).alias("a"))))
    first = lambda x, y: F.get(F.array_except(x, y), F.lit(0))
    changed = F.transform("_f", lambda f: F.struct(first(f["b"], f["a"]).alias("was"), first(f["a"], f["b"]).alias("now")))
    rows = once(rows, _c=F.filter(changed, lambda x: x["was"].isNotNull() & x["now"].isNotNull()))
    linked = lambda x, y: joined_names(F.col(before), x["was"], y["was"]) | joined_names(F.col(after), x["now"], y["now"])
    links = F.transform("_c", lambda x, i: F.filter(F.transform("_c", lambda y, j: F.when((i == j) | linked(x, y), j)), lambda j: j.isNotNull()))
    rows = once(rows, _l=F.when(F.size("_c") >= least, links).otherwise(F.array().cast("array<array<int>>")))
    smallest = lambda labels, _: F.transform("_l", lambda near: F.array_min(F.transform(near, lambda j: F.get(labels, j))))
    groups = F.size(F.array_distinct(F.aggregate("_l", F.transform("_l", lambda _, i: i), smallest)))
    return rows.select(*pairs.columns, F.when(groups >= least, F.col("_c")).otherwise(F.array().cast("array<struct<was:string,now:string>>")).alias("roles"))


def changed_units(pairs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """pairs with `units`: array of number, was and now: numbers that stayed while no unit after them did."""

    def found(c: str) -> Column:
        text = F.coalesce(F.col(c), F.lit(""))
        each = F.arrays_zip(F.regexp_extract_all(text, F.lit(NUMBER_UNIT), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(NUMBER_UNIT), F.lit(2)).alias("w"))
        return F.filter(F.transform(each, lambda x: F.struct(F.replace(x["n"], F.lit(","), F.lit(".")).alias("number"), x["w"].alias("word"), unit(F.lower(x["w"])).alias("unit"))), lambda x: x["unit"].isNotNull())

    rows = once(pairs, _bu=found(before), _au=found(after))
    rows = once(rows, _numbers=F.array_distinct(F.transform("_au", lambda x: x["number"])))
    of = lambda c, n: F.filter(c, lambda x: x["number"] == n)
    rows = once(rows, _u=F.transform("_numbers", lambda n: F.struct(n.alias("number"), of("_bu", n).alias("b"), of("_au", n).alias("a"))))
    units = lambda x: F.transform(x, lambda y: y["unit"])
    lost = F.filter("_u", lambda x: (F.size(x["b"]) > 0) & ~F.arrays_overlap(units(x["b"]), units(x["a"])))
    return rows.select(*pairs.columns, F.transform(lost, lambda x: F.struct(x["number"].alias("number"), F.get(x["b"], F.lit(0))["word"].alias("was"), F.get(x["a"], F.lit(0))["word"].alias("now"))).alias("units"))


def new_names(pairs: DataFrame, before: str = "before", after: str = "after", prose: str | None = None) -> DataFrame:
    """pairs with `names`: names, words of Latin letters and acronyms of the edited text (of `prose` where given, a text of
    the same length) that the source has no form of, each once, in their order.

    A capital at the start of a sentence or line says nothing, polite forms are no names, a vowel of the last syllable may be
    lost in other forms, and an acronym may stand for words of the source that follow each other. Words that the
    source has as they are leave by a set difference first, so forms are compared for new words only.
    """
    text = F.coalesce(F.col(prose or after), F.lit(""))
    found = F.regexp_extract_all(F.regexp_replace(text, STARTS, "$0" + MARK), F.lit(rf"{MARK}?\p{{L}}+"), F.lit(0))
    each = F.transform(found, lambda x: F.struct(F.ltrim(x, F.lit(MARK)).alias("word"), F.startswith(x, F.lit(MARK)).alias("at_start")))
    name = lambda x: (F.length(x["word"]) >= 2) & (x["word"].rlike(r"\p{IsLatin}") | x["word"].rlike(r"^\p{Lu}{2}") | (x["word"].rlike(r"^\p{Lu}") & ~x["at_start"]))
    rows = once(pairs, _w=letters(F.coalesce(F.col(before), F.lit(""))), _n=F.filter(each, name))
    rows = once(rows, _s=F.array_distinct("_w"), _heads=F.array_join(F.transform("_w", lambda w: F.left(w, F.lit(1))), ""), _lower=F.transform("_n", lambda x: F.lower(x["word"])))
    rows = once(rows, _new=F.array_except("_lower", F.concat("_s", F.array(*map(F.lit, POLITE)))))
    forms = lambda w: F.when(w.rlike(FLEETING), F.concat(F.substr(w, F.lit(1), F.length(w) - 2), F.right(w, F.lit(1)))).otherwise(w)
    rows = once(rows, _forms=F.array_distinct(F.when(F.size("_new") > 0, F.concat("_s", F.transform("_s", forms))).otherwise(F.array().cast(STRINGS))))
    near = lambda w: F.exists("_forms", lambda o: (F.left(o, F.lit(2)) == F.left(w, F.lit(2))) & same_stem(w, o))
    alias = lambda w: F.coalesce(F.array_contains("_s", F.when(w == "ai", "ии").when(w == "ии", "ai")), F.lit(False))
    rows = once(rows, _left=F.filter("_new", lambda w: ~alias(w) & ~near(w)))
    first = lambda w: F.get("_n", (F.array_position("_lower", w) - 1).cast("int"))["word"]
    head = lambda x: F.lower(F.regexp_extract(x, r"^\p{Lu}{2,6}(?!\p{Lu})", 0))
    spelt = lambda x: ~x.rlike(r"\p{IsLatin}") & (head(x) != "") & F.contains(F.col("_heads"), head(x))
    return rows.select(*pairs.columns, F.filter(F.transform("_left", first), lambda x: ~spelt(x)).alias("names"))
