r"""Personal data and secrets: keyed surrogates, in SQL functions only.

One alternation of patterns finds the entities of a text; the text is then put together again from
the gaps and the surrogates, inside the row and without a shuffle.

Surrogates. Digits stay digits, capitals stay capitals, small letters stay small, hexadecimal strings
stay hexadecimal and punctuation stays, so type, script and format match. Two passes shift each
character by keyed digests of what stands before and after it. Either pass can be undone with the key,
so the map is one to one on the strings of a format: distinct entities get distinct surrogates and
equal ones the same, in every document, without a table of the corpus. Secrets of more than 200
characters go block by block, each under a digest of what stands before it. Of a telephone number the
country code stays; a card number or account number
that passes its check digits has a surrogate that does, with the country of an account; an address keeps valid octets (1 to 223, 0 to
255 is mapped one to one per octet), and an e-mail address keeps its dots and its last label.

Names are found after a form of address, full ones after a label ("Name:", "my name is") too; after a
label the gender follows from the ending. Given names and surnames are drawn apart from each other, from
lists by gender and script, so a surname has one surrogate with and without a given name. Where it stands
again without a form of address in the same document, alone or after a given name of the document, it is
replaced too. Lists are finite, so each document is checked: if two of its surnames (or given names) share
a surrogate, or one equals a surname (given name) of the document, these alone are drawn again with the
next tweak; after the last tweak they are numbered, which cannot collide. All else keeps its surrogate.
"""

from __future__ import annotations

import hmac

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMS = r"Mr|Mrs|Ms|Miss|Mme|Mlle|Herr|Frau|Sr|Sra|Se\u00f1or|Se\u00f1ora|\u03ba|\u039a\u03cd\u03c1\u03b9\u03bf\u03c2|\u039a\u03c5\u03c1\u03af\u03b1|\u0433-\u043d|\u0433-\u0436\u0430"
#: Words before a full name that say that it is one.
LABELS = r"(?:[Ff]ull |[Mm]y )?[Nn]ame(?::| is)|(?:[Cc]ontact|[Cc]ustomer|[Pp]atient|[Ee]mployee|[Aa]ttn|[Ss]igned):"
#: Between the name of a secret and its value.
SET = r"[ \t]{0,4}[=:][ \t]{0,4}[\"']?"
#: Types in the order of the alternation; each has one pattern without groups (Java syntax).
PATTERNS = {
    "secret": rf"(?i:\b(?:pass(?:word|wd|phrase)?|pwd)[\"']?{SET}[^\s\"'<>,;)\]}}]*[^\s\"'<>,;)\]}}.]|\b(?:secret|token|api[_-]?key|access[_-]?key|auth)[\"']?(?:[ \t]{{0,4}}=[ \t]{{0,4}}[\"']?[A-Za-z0-9+/_.~\-]*|{SET}(?:[A-Za-z0-9+/_.~\-]{{7,}}|(?=[A-Za-z+/_.~\-]*\d)[A-Za-z0-9+/_.~\-]*))[A-Za-z0-9+/_~\-]={{0,2}})",
    "access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "email": r"(?<![\w.+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}\b",
    "ipv4": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\w.\-])\d(?:[ \-]?\d){12,18}(?![\w]|[.\-]\d)",
    "phone": r"(?<![\w.+])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\w)|(?<![\w.+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,4}(?!\w)|(?<![\w.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w])",
    "national_id": r"(?<![\w.\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "name": rf"\b(?:{FORMS})\.? \p{{Lu}}\p{{Ll}}{{1,30}}(?: \p{{Lu}}\p{{Ll}}{{1,30}})?|\b(?:{LABELS}) \p{{Lu}}\p{{Ll}}{{1,30}} \p{{Lu}}\p{{Ll}}{{1,30}}",
}

#: Fixed lists of invented replacements: given names by gender and surnames, by script.
NAMES = {
    ("m", "latin"): "Adam Boris Colin Edgar Felix Gavin Hugo Ivan Jonas Karl Lars Milan Nico Oscar Pablo Ralf Simon Tomas Victor Walter",
    ("f", "latin"): "Alma Berta Clara Diana Elsa Flora Greta Helga Irma Julia Karla Lena Mara Nora Olga Petra Rosa Sonia Tilda Vera",
    ("m", "greek"): "Άρης Βασίλης Γιώργος Δημήτρης Ηλίας Κώστας Λάμπρος Μάριος Νίκος Πέτρος",
    ("f", "greek"): "Άννα Βάσω Γεωργία Δήμητρα Ελένη Κατερίνα Λίνα Μαρία Νίκη Σοφία",
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим",
    ("f", "cyrillic"): "Алла Вера Галина Дарья Елена Жанна Инна Кира Лидия Мария",
    ("s", "latin"): "Abbot Barlow Carver Dalton Ember Fowler Garner Hollis Ingram Jarvis Keller Lowell Marlow Norton Orwin Palmer Quint Rowan Sutter Tanner",
    ("s", "greek"): "Αλεξίου Βλάχου Γεωργίου Δήμου Ιωάννου Κωστή Λάμπρου Μάρκου Νικολάου Παύλου",
    ("s", "cyrillic"): "Белых Долгих Крутых Малых Польских Седых Тонких Черных Широких Юных",
}
TWEAKS = 3
#: A name without a form of address, where the document has it with one.
BARE = r"^(?:\p{Lu}\p{Ll}{1,30} )?\p{Lu}\p{Ll}{1,30}$"
BLOCK = 200
UNION = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _lit(s: str) -> str:
    """An SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def kind_sql(e: str) -> str:
    """SQL: the type of entity ``e``, the first whose pattern matches all of it."""
    return "CASE " + " ".join(f"WHEN {e} RLIKE {_lit('^(?:' + p + ')$')} THEN '{k}'" for k, p in PATTERNS.items()) + f" WHEN {e} RLIKE {_lit(BARE)} THEN 'name' ELSE 'secret' END"


def _byte(key: str, x: str) -> str:
    return f"cast(conv(substr(sha2(concat({key}, {x}), 256), 1, 8), 16, 10) as bigint)"


def _shift(c: str, amount: str, hexa: str) -> str:
    """SQL: character ``c`` moved on by ``amount`` within its class."""
    return (
        f"CASE WHEN {c} BETWEEN '0' AND '9' THEN char(48 + (ascii({c}) - 48 + {amount}) % 10)"
        f" WHEN {c} BETWEEN 'a' AND 'z' THEN char(97 + (ascii({c}) - 97 + {amount}) % IF({hexa}, 6, 26))"
        f" WHEN {c} BETWEEN 'A' AND 'Z' THEN char(65 + (ascii({c}) - 65 + {amount}) % IF({hexa}, 6, 26)) ELSE {c} END"
    )


def _scramble(s: str, key: str) -> str:
    """SQL: one-to-one, format-keeping image of string ``s`` under ``key`` (two passes)."""
    hexa = f"({s} RLIKE '^(?:[0-9a-f]+|[0-9A-F]+)$')"
    skeleton = f"regexp_replace(regexp_replace(regexp_replace({s}, '[0-9]', '0'), '[a-z]', 'a'), '[A-Z]', 'A')"
    first = f"concat_ws('', transform(sequence(1, length({s})), i -> {_shift(f'substr({s}, i, 1)', _byte(f'concat({key}, 1, {skeleton})', f'concat(i, substr({s}, 1, i - 1))'), hexa)}))"
    return f"concat_ws('', transform(array({first}), f -> concat_ws('', transform(sequence(1, length(f)), i -> {_shift('substr(f, i, 1)', _byte(f'concat({key}, 2, {skeleton})', 'concat(i, substr(f, i + 1))'), hexa)}))))"


def _octets(s: str, key: str) -> str:
    """SQL: one-to-one image of an address: two rounds of keyed additions, octet by octet (1 to 223 in front)."""
    one = f"transform(sequence(0, 3), i -> (cast(split({s}, '[.]')[i] as bigint) + {_byte(key, f'concat(1, i, array_join(slice(split({s}, chr(91) || chr(46) || chr(93)), 1, i), chr(46)))')}) % 256)"
    two = f"transform(array({one}), o -> array_join(transform(sequence(0, 3), i -> cast((o[i] + {_byte(key, 'concat(2, i, array_join(slice(o, i + 2, 3), chr(46)))')}) % 256 as string)), '.'))[0]"
    return two


def _luhn(x: str) -> str:
    """SQL: the check digit that makes the digits ``x`` a card number."""
    doubled = "2 * d - IF(d > 4, 9, 0)"
    return f"(10 - aggregate(transform(sequence(1, length({x})), i -> transform(array(cast(substr({x}, -i, 1) as int)), d -> IF(i % 2 = 1, {doubled}, d))[0]), 0, (a, v) -> a + v) % 10) % 10"


def _card(s: str, key: str) -> str:
    """SQL: one-to-one image of a card number; the last digit is off its check digit by as much as before, so valid ones stay valid."""
    digits = lambda v: f"regexp_replace({v}, '[^0-9]', '')"
    off = f"(cast(right({s}, 1) as int) - {_luhn('x')} + 10)"
    front = f"substr({s}, 1, length({s}) - 1)"
    return f"transform(array({_scramble(front, key)}), p -> concat(p, transform(array({digits('p')}), y -> (({_luhn('y')}) + transform(array({digits(front)}), x -> {off})[0]) % 10)[0]))[0]"


def _mod97(x: str) -> str:
    """SQL: the number that letters and digits ``x`` stand for, modulo 97."""
    return f"aggregate(split({x}, ''), 0, (a, c) -> CASE WHEN c BETWEEN '0' AND '9' THEN (a * 10 + ascii(c) - 48) % 97 WHEN c BETWEEN 'A' AND 'Z' THEN (a * 100 + ascii(c) - 55) % 97 ELSE a END)"


def _iban(s: str, key: str) -> str:
    """SQL: one-to-one image of an account number with its country; check digits are off by as much as before, so valid ones stay valid."""
    right_for = lambda v: f"(98 - {_mod97(f'concat({v}, substr({s}, 1, 2), chr(48), chr(48))')})"
    own = f"cast(substr({s}, 3, 2) as int)"
    check = f"IF({own} BETWEEN 2 AND 98, lpad(cast(2 + ({right_for('b')} + {own} - {right_for(f'substr({s}, 5)')} + 95) % 97 as string), 2, '0'), substr({s}, 3, 2))"
    return f"transform(array({_scramble(f'substr({s}, 5)', key)}), b -> concat(substr({s}, 1, 2), {check}, b))[0]"


def _pick(words: str, x: str) -> str:
    n = len(words.split())
    return f"split({_lit(words)}, ' ')[cast({x} % {n} as int)]"


def _blocks(s: str, key: str) -> str:
    """SQL: one-to-one image of a string of any length, block by block."""
    part = _scramble("q.x", f"concat({key}, q.k)")
    more = f"transform(sequence(0, (length(v) - 1) div {BLOCK}), b -> named_struct('x', substr(v, b * {BLOCK} + 1, {BLOCK}), 'k', IF(b = 0, '', sha2(substr(v, 1, b * {BLOCK}), 256))))"
    return f"concat_ws('', transform(array({s}), v -> IF(v = '', '', concat_ws('', transform({more}, q -> {part})))))"


def _form(e: str) -> str:
    return f"regexp_extract({e}, {_lit('^(?:(?:' + FORMS + ')[.]?|' + LABELS + ') ')}, 0)"


def _surname(e: str) -> str:
    return f"regexp_extract({e}, '(\\\\S+)$', 1)"


def _given(e: str) -> str:
    """SQL: the given name, or the empty string."""
    return f"regexp_extract(substr({e}, length({_form(e)}) + 1), '^(\\\\S+) ', 1)"


def _gender(e: str) -> str:
    female = f"regexp_replace({_form(e)}, '[. ]', '') IN ('Mrs', 'Ms', 'Miss', 'Mme', 'Mlle', 'Frau', 'Sra', 'Señora', 'Κυρία', 'г-жа')"
    ending = f"{_form(e)} RLIKE {_lit('^(?:' + LABELS + ') $')} AND {_given(e)} RLIKE '[aαηая]$'"
    return f"IF({female} OR {ending}, 'f', 'm')"


def _name(w: str, lists: dict[str, str], key: str) -> str:
    """SQL: an invented name of the script of ``w``, from ``lists`` by script."""
    script = f"CASE WHEN {w} RLIKE '\\\\p{{IsGreek}}' THEN 'greek' WHEN {w} RLIKE '\\\\p{{IsCyrillic}}' THEN 'cyrillic' ELSE 'latin' END"
    return f"CASE {script} " + " ".join(f"WHEN '{s}' THEN {_pick(x, _byte(key, w))}" for s, x in lists.items()) + " END"


def _lists(which: str) -> dict[str, str]:
    return {s: x for (g, s), x in NAMES.items() if g == which}


def _surnames(key: str, number: str = "''") -> str:
    """SQL: the surrogates of the surnames ``_u``."""
    return f"transform(_u, (w, i) -> concat({_name('w', _lists('s'), key)}, {number}))"


def _givens(key: str, number: str = "''") -> str:
    """SQL: the surrogates of the given names ``_g``, which have their gender in front."""
    one = f"IF(startswith(g, 'f'), {_name('substr(g, 2)', _lists('f'), key)}, {_name('substr(g, 2)', _lists('m'), key)})"
    return f"transform(_g, (g, i) -> concat({one}, {number}))"


def _named(e: str) -> str:
    """SQL: the form of address, if any, and the surrogates of a name of the document."""
    given = f"IF({_form(e)} = '', get(filter(_g, g -> substr(g, 2) = {_given(e)}), 0), concat({_gender(e)}, {_given(e)}))"
    first = f"IF({_given(e)} = '', '', concat(element_at(_gs, cast(array_position(_g, {given}) as int)), ' '))"
    return f"concat({_form(e)}, {first}, element_at(_us, cast(array_position(_u, {_surname(e)}) as int)))"


def surrogate_sql(e: str, kind: str, key: str) -> str:
    """SQL: the surrogate of entity ``e`` of type ``kind``; of a name, from ``_g``, ``_gs``, ``_u`` and ``_us``."""
    head = f"regexp_extract({e}, '^(?i:[a-z]+(?:[_-]?key)?[\"\\']?[ \\\\t]*[=:][ \\\\t]*[\"\\']?)', 0)"
    at = f"regexp_extract({e}, '[.][A-Za-z]+$', 0)"
    code = f"regexp_extract({e}, '^[+][0-9]{{1,3}}(?=[ .(-])', 0)"
    rest = lambda h: f"substr({e}, length({h}) + 1)"
    return (
        f"CASE {kind} WHEN 'secret' THEN concat({head}, {_blocks(rest(head), key)})"
        f" WHEN 'access_key' THEN concat(substr({e}, 1, 4), {_scramble(f'substr({e}, 5)', key)})"
        f" WHEN 'email' THEN concat({_scramble(f'substr({e}, 1, length({e}) - length({at}))', key)}, {at})"
        f" WHEN 'ipv4' THEN {_octets(e, key)}"
        f" WHEN 'card' THEN {_card(e, key)}"
        f" WHEN 'iban' THEN {_iban(e, key)}"
        f" WHEN 'phone' THEN concat({code}, {_scramble(rest(code), key)})"
        f" WHEN 'name' THEN {_named(e)}"
        f" ELSE {_scramble(e, key)} END"
    )


def _drawn(made: str, words: str) -> str:
    """SQL: the array ``made``, or null where its names collide with each other or with ``words``."""
    return f"get(filter(array({made}), m -> size(array_distinct(m)) = size(m) AND NOT arrays_overlap(m, {words})), 0)"


def _keys(spark: SparkSession, secret: str, tweaks: int) -> DataFrame:
    """One row of keys, one for each use. They are data, so that neither plans nor event logs show them."""
    labels = {"_k": "all"} | {f"_k{w}{t}": f"names{w}/{t}" for w in ("_u", "_g") for t in [*range(tweaks), "n"]}
    keys = [hmac.new(secret.encode(), label.encode(), "sha256").hexdigest() for label in labels.values()]
    return spark.createDataFrame([tuple(keys)], ", ".join(f"{c} string" for c in labels))


def pseudonymize(docs: DataFrame, secret: str, tweaks: int = TWEAKS) -> DataFrame:
    """The columns of ``docs`` with ``text`` replaced, and n_entities (long) and kinds (array of types, as found).

    A text without entities is returned unchanged; a null text stays null with 0 entities. Rows that
    repeat are treated alike. n_chars, where present, is left as it is. Input columns named as the
    added ones are replaced. Who has the key ``secret`` can undo the map, so there is no default.
    """
    names = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    union = _lit(UNION)
    df = docs.select(F.struct("*").alias("_row"), "text").withColumn("_m", F.expr(f"coalesce(regexp_extract_all(text, {union}, 0), array())"))
    df = df.crossJoin(F.broadcast(_keys(docs.sparkSession, secret, tweaks)))
    df = df.withColumn("_n", F.expr(f"filter(_m, e -> {kind_sql('e')} = 'name')"))
    df = df.withColumn("_u", F.expr(f"array_distinct(transform(_n, e -> {_surname('e')}))"))
    df = df.withColumn("_g", F.expr(f"array_distinct(transform(filter(_n, e -> {_given('e')} <> ''), e -> concat({_gender('e')}, {_given('e')})))"))
    word = r"[\p{L}\p{N}_]"
    bare = f"concat({_lit(f'|(?<!{word})(?:(?:(?!)')}, concat_ws('', transform(_g, g -> concat('|', substr(g, 2)))), {_lit(') )?(?:')}, array_join(_u, '|'), {_lit(f')(?!{word})')})"
    df = df.withColumn("_p", F.expr(f"IF(size(_u) = 0, {union}, concat({union}, {bare}))"))
    df = df.withColumn("_m", F.expr("IF(size(_u) = 0, _m, regexp_extract_all(text, _p, 0))")).withColumn("_e", F.array_distinct("_m"))
    for out, words, plain, draw, number in (("_us", "_u", "_u", _surnames, "concat(' ', i + 2)"), ("_gs", "_g", "transform(_g, g -> substr(g, 2))", _givens, "cast(i + 2 as string)")):
        choices: list[Column] = [F.expr(_drawn(draw(f"_k{words}{t}"), plain)) for t in range(tweaks)]
        df = df.withColumn(out, F.when(F.size(words) > 0, F.coalesce(*choices, F.expr(draw(f"_k{words}n", number)))))
    found = F.size("_m") > 0
    df = df.withColumn("_s", F.when(found, F.expr(f"transform(_e, e -> {surrogate_sql('e', kind_sql('e'), '_k')})")))
    put = """concat_ws('', flatten(zip_with(split(text, _p, -1), _m,
        (g, m) -> IF(m IS NULL, array(g), array(g, element_at(_s, cast(array_position(_e, m) as int)))))))"""
    kinds = F.expr(f"transform(_m, e -> {kind_sql('e')})")
    return df.select(
        *[F.when(found, F.expr(put)).otherwise(F.col("text")).alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in names],
        F.size("_m").cast("long").alias("n_entities"),
        F.when(found, kinds).otherwise(F.array().cast("array<string>")).alias("kinds"),
    )


#: The key of the registered queries, whose results have to repeat; real data need a key of their own.
QUERY_KEY = "public key of the queries"


def surrogates(docs: DataFrame, secret: str = QUERY_KEY) -> DataFrame:
    """doc_id, text with surrogates, and the number and types of the entities."""
    return pseudonymize(docs.select("doc_id", "text"), secret)
