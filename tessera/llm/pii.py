"""Personal data: detection and keyed surrogates.

Native: DataFrame functions alone. One pattern finds e-mail and IP addresses, phone,
card, bank account and social security numbers, secrets, and names after a form of
address. Each distinct entity gets one surrogate for the whole table, from a keyed
hash: letters become letters of the same script, digits digits, and the punctuation,
case, top-level domain, country code, card network and a valid check digit stay. A
name's words are entities of their own, given names by gender and script, so that a
family name alone still refers to the same person.

Collision checks: a surrogate that is also a real entity of its kind, or already the
surrogate of another one, is drawn anew with the next attempt number, names in the end
with more letters, until none is left. So distinct entities stay distinct, and every mention of one stays the same.

Secrets and the parts of an e-mail address may have any length (a domain at most 127 labels, the system's own limit);
bank account and card numbers have those of their standards.

Defined results: null text stays null. Rows that share a doc_id are told apart by a
hash of the text. Extra columns pass through; columns named like the outputs are
replaced. The surrogates depend on the key and on the set of entities, not on the
order or number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import settle, small, table

ATTEMPTS = 64
LEFT, RIGHT = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# Forms of address, and names to draw from.
MALE_FORMS = ("Mr", "Herr", "Monsieur", "Señor", "Господин", "Κύριος")
FEMALE_FORMS = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Госпожа", "Κυρία")
NAMES = {
    "male:latin": "Adrian Albert Bruno Carl Daniel Erik Felix Gustav Hugo Ivan Jonas Karl Leon Martin Nils Oscar Paul Robert Simon Victor",
    "female:latin": "Alice Anna Clara Diana Elena Emma Flora Greta Helen Ines Julia Karin Laura Maria Nora Olga Paula Rosa Sofia Vera",
    "family:latin": "Adler Baker Costa Dumont Ekman Fischer Garner Holm Ivers Jansen Keller Lindt Moreau Novak Ortega Palmer Reyes Stone Torres Vogel",
    "male:cyrillic": "Алексей Борис Виктор Глеб Денис Егор Иван Кирилл Максим Олег",
    "female:cyrillic": "Алина Вера Галина Дарья Елена Ирина Марина Нина Ольга Тамара",
    "family:cyrillic": "Беленко Гончар Дорош Жук Коваль Лысенко Мороз Ткач Шевчук Яценко",
    "male:greek": "Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Πέτρος",
    "female:greek": "Άννα Δήμητρα Ελένη Κατερίνα Μαρία Σοφία",
    "family:greek": "Βασιλείου Γεωργίου Δημητρίου Ιωάννου Νικολάου Παύλου",
}
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

FORM = "|".join(MALE_FORMS + FEMALE_FORMS)
IP = rf"(?<![\p{{L}}\p{{N}}.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?[\p{{L}}\p{{N}}])"
WORD = r"\p{Lu}[\p{L}'’-]+"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.){1,127}\p{L}{2,}" + RIGHT,
    "name": rf"{LEFT}(?:{FORM})\.? {WORD}(?: {WORD}){{0,2}}{RIGHT}",
    "ip": IP,
    "secret": rf"{LEFT}(?:[A-Fa-f0-9]{{32,}}+|(?:sk|pk|ghp|gho|xoxb|xoxp|AKIA|AIza)[A-Za-z0-9_-]{{16,}}){RIGHT}",
    "iban": rf"{LEFT}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{RIGHT}",
    "card": rf"{LEFT}(?:\d{{13,19}}|\d{{4}}[ -]\d{{4}}[ -]\d{{4}}[ -]\d{{1,7}}){RIGHT}",
    "ssn": rf"{LEFT}\d{{3}}-\d{{2}}-\d{{4}}{RIGHT}",
    "phone": rf"(?:(?<![\p{{L}}\p{{N}}])\+\d{{1,3}}[ .-]?\(?\d{{1,4}}\)?(?:[ .-]?(?!{IP})\d{{2,4}}){{2,4}}|(?<![\p{{L}}\p{{N}}+])\(?\d{{3}}\)?[ .-]\d{{3}}[ .-]\d{{4}}){RIGHT}",
}
ANY = "|".join(PATTERNS.values())


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def kind_of(m: str) -> str:
    """SQL: the kind of a match, the first pattern that fits all of it."""
    return "CASE " + " ".join(f"WHEN regexp_like({m}, {_q('^(?:' + p + ')$')}) THEN '{k}'" for k, p in PATTERNS.items()) + " ELSE 'phone' END"


SCRIPT = "CASE WHEN regexp_like({0}, '\\\\p{{IsCyrillic}}') THEN 'cyrillic' WHEN regexp_like({0}, '\\\\p{{IsGreek}}') THEN 'greek' ELSE 'latin' END"


def _atoms(m: str) -> str:
    """SQL: array of 'kind:norm' entities of a match struct (kind, text)."""
    words = f"slice(split({m}.text, ' '), 2, 9)"
    gender = f"if(regexp_like({m}.text, {_q('^(?:' + '|'.join(FEMALE_FORMS) + ')')}) AND NOT regexp_like({m}.text, {_q('^(?:' + '|'.join(MALE_FORMS) + r')(?:\.| )')}), 'female', 'male')"
    names = f"transform({words}, (w, i) -> concat(if(i = size({words}) - 1, 'family', {gender}), ':', {SCRIPT.format('w')}, ':', lower(w)))"
    norm = f"CASE WHEN {m}.kind IN ('phone', 'card', 'ssn') THEN regexp_replace({m}.text, '[^0-9]', '') WHEN {m}.kind = 'iban' THEN lower(replace({m}.text, ' ', '')) WHEN {m}.kind = 'secret' AND NOT regexp_like({m}.text, '^[A-Fa-f0-9]+$') THEN {m}.text ELSE lower({m}.text) END"
    return f"if({m}.kind = 'name', {names}, array(concat({m}.kind, '::', {norm})))"


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, tid, found): the matches in order, each with its kind, of rows that have any."""
    t = F.col(f"`{text}`")
    hit = docs.select("doc_id", F.xxhash64(t).alias("tid"), F.regexp_extract_all(t, F.lit(ANY), F.lit(0)).alias("m")).where("size(m) > 0").distinct()
    return hit.selectExpr("doc_id", "tid", f"transform(m, x -> named_struct('kind', {kind_of('x')}, 'text', x)) AS found")


def _v(p: str) -> str:
    """SQL: byte number p (from 1, around 128) of the hash stream h."""
    return f"cast(conv(substr(h, (({p} - 1) % 128) * 2 + 1, 2), 16, 10) AS int)"


def _luhn(digits: str) -> str:
    """SQL: Luhn sum of a string of digits."""
    d = f"cast(substr({digits}, -p, 1) AS int)"
    return f"aggregate(sequence(1, length({digits})), 0, (a, p) -> a + if(p % 2 = 1, {d}, if({d} > 4, 2 * {d} - 9, 2 * {d})))"


def surrogate() -> Column:
    """The surrogate of columns kind, script, norm and the hash stream h."""
    letters = " ".join(f"WHEN regexp_like(substr(norm, p, 1), '\\\\p{{Is{s.capitalize()}}}') THEN substr('{a}', {_v('p')} % {len(a)} + 1, 1)" for s, a in LETTERS.items())
    digit = f"substr('0123456789', {_v('p')} % 10 + 1, 1)"
    chars = f"CASE WHEN p > upto THEN substr(norm, p, 1) WHEN regexp_like(substr(norm, p, 1), '[0-9]') THEN {digit} {letters} ELSE substr(norm, p, 1) END"
    mapped = f"array_join(transform(sequence(1, length(norm)), p -> {chars}), '')"
    email = mapped.replace("upto", "(length(norm) - length(substring_index(norm, '.', -1)) - 1)")
    hexed = f"array_join(transform(sequence(1, length(norm)), p -> if(regexp_like(substr(norm, p, 1), '[0-9]'), {digit}, substr('abcdef', {_v('p')} % 6 + 1, 1))), '')"
    secret = f"if(regexp_like(norm, '^[a-f0-9]+$'), {hexed}, concat(substr(norm, 1, 4), array_join(transform(sequence(5, length(norm)), p -> CASE WHEN regexp_like(substr(norm, p, 1), '[0-9]') THEN {digit} WHEN regexp_like(substr(norm, p, 1), '[A-Z]') THEN upper(substr('{LETTERS['latin']}', {_v('p')} % 26 + 1, 1)) WHEN regexp_like(substr(norm, p, 1), '[a-z]') THEN substr('{LETTERS['latin']}', {_v('p')} % 26 + 1, 1) ELSE substr(norm, p, 1) END), '')))"
    digits = lambda keep: f"concat(substr(norm, 1, {keep}), array_join(transform(sequence({keep} + 1, length(norm)), p -> {digit}), ''))"
    stem = f"substr({digits('1')}, 1, length(norm) - 1)"
    card = f"if({_luhn('norm')} % 10 = 0, concat({stem}, cast((10 - {_luhn(f'concat({stem}, {_q(chr(48))})')} % 10) % 10 AS string)), {digits('1')})"
    iban = f"concat(substr(norm, 1, 2), array_join(transform(sequence(3, length(norm)), p -> if(regexp_like(substr(norm, p, 1), '[0-9]'), {digit}, substr('{LETTERS['latin']}', {_v('p')} % 26 + 1, 1))), ''))"
    ip = f"concat_ws('.', 1 + {_v('1')} % 223, {_v('2')}, {_v('3')}, 1 + {_v('4')} % 254)"
    pick = {k: f"element_at(array({', '.join(_q(n.lower()) for n in v.split())}), {_v('1')} % {len(v.split())} + 1)" for k, v in NAMES.items()}
    more = lambda a, n: f"if({n} < 1, '', array_join(transform(sequence(1, greatest({n}, 1)), p -> substr('{a}', {_v('(p + 1)')} % {len(a)} + 1, 1)), ''))"
    grow = " ".join(f"WHEN '{s}' THEN {more(a, 'attempt div 2')}" for s, a in LETTERS.items())
    name = "concat(CASE concat(kind, ':', script) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in pick.items()) + f" END, CASE script {grow} END)"
    email = f"concat({more(LETTERS['latin'], 'attempt div 2 - 3')}, {email})"
    return F.expr(f"CASE kind WHEN 'email' THEN {email} WHEN 'secret' THEN {secret} WHEN 'iban' THEN {iban} WHEN 'ip' THEN {ip} WHEN 'card' THEN {card} WHEN 'ssn' THEN {digits('0')} WHEN 'phone' THEN {digits('greatest(length(norm) - 10, 0)')} ELSE {name} END")


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(atom, value): a surrogate for each distinct entity, none shared and none real.

    With every second attempt a name gets one more letter, and from the eighth on an address too, so the
    rounds grow with the logarithm of the number of entities. The other kinds keep their length: more of
    them than their format has values is an error after ATTEMPTS rounds.
    """
    parts = F.split("atom", ":", 3)
    real = entities.select("atom", parts[0].alias("kind"), parts[1].alias("script"), parts[2].alias("norm"), F.lit(0).alias("attempt"))
    names, done = settle(real, "entities"), None
    todo, own = names, names.select("kind", F.col("norm").alias("value"))
    for _ in range(ATTEMPTS):
        seed = F.concat_ws("/", F.lit(key), "atom", "attempt")
        h = F.concat(*(F.sha2(F.concat_ws("/", seed, F.lit(i)).cast("binary"), 256) for i in range(4)))
        drawn = settle(todo.withColumn("h", h).select("atom", "kind", "script", "norm", "attempt", surrogate().alias("value")), "drawn")
        free = drawn.join(own, ["kind", "value"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "value"), ["kind", "value"], "left_anti")
        won = free.groupBy("kind", "value").agg(F.min("atom").alias("atom"))
        done = settle(won if done is None else done.unionByName(won), "surrogates")
        todo = settle(drawn.join(done.select("atom"), "atom", "left_anti").select("atom", "kind", "script", "norm", (F.col("attempt") + 1).alias("attempt")), "redrawn")
        if todo.isEmpty():
            return done.select("atom", "value")
    raise ValueError(f"no free surrogate after {ATTEMPTS} rounds; more entities than their format has values")


def _render(x: str) -> str:
    """SQL: the replacement of a match struct, from the map `names` of atom -> value."""
    atoms = _atoms(x)
    first = f"try_element_at(names, element_at({atoms}, 1))"
    cased = f"if({x}.text = upper({x}.text), upper({first}), {first})"
    pour = f"aggregate(split({x}.text, ''), named_struct('i', 0, 'out', ''), (a, c) -> if(regexp_like(c, '[A-Za-z0-9]'), named_struct('i', a.i + 1, 'out', concat(a.out, substr(upper({first}), a.i + 1, 1))), named_struct('i', a.i, 'out', concat(a.out, c)))).out"
    words = f"concat(split_part({x}.text, ' ', 1), ' ', array_join(transform({atoms}, y -> initcap(try_element_at(names, y))), ' '))"
    return f"CASE WHEN {x}.kind IN ('phone', 'card', 'ssn', 'iban') THEN {pour} WHEN {x}.kind = 'name' THEN {words} ELSE {cased} END"


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with surrogates in text, plus n_entities and entity_kinds (kind=count, joined by commas)."""
    new = ("n_entities", "entity_kinds")
    kept = [c for c in docs.columns if c not in new]
    docs = docs.select(*(F.col(f"`{c}`") for c in kept))
    found = settle(find(docs, text), "found")
    atoms = settle(found.select("doc_id", "tid", F.explode(F.expr(f"array_distinct(flatten(transform(found, x -> {_atoms('x')})))")).alias("atom")), "atoms")
    values = assign(atoms.select("atom").distinct(), key)
    named = atoms.join(small(values), "atom").groupBy("doc_id", "tid").agg(F.map_from_entries(F.collect_list(F.struct("atom", "value"))).alias("names"))
    same = found["doc_id"].eqNullSafe(named["doc_id"]) & (found["tid"] == named["tid"])
    plan = found.join(named, same).select(found["doc_id"].alias("__d"), found["tid"].alias("__t"), "names", "found")
    d = docs.withColumn("__tid", F.xxhash64(F.col(f"`{text}`")))
    d = d.join(plan, d["doc_id"].eqNullSafe(plan["__d"]) & (d["__tid"] == plan["__t"]), "left")
    pieces = f"split(`{text}`, {_q(ANY)}, -1)"
    put = f"array_join(flatten(zip_with({pieces}, transform(found, x -> {_render('x')}), (a, b) -> array(a, coalesce(b, '')))), '')"
    out = F.expr(f"if(names IS NULL, `{text}`, {put})")
    kinds = "coalesce(array_join(filter(transform(array({}), k -> if(exists(found, x -> x.kind = k), concat(k, '=', size(filter(found, x -> x.kind = k))), null)), z -> z IS NOT NULL), ','), '')".format(", ".join(_q(k) for k in PATTERNS))
    return d.select(*(out.alias(text) if c == text else F.col(f"`{c}`") for c in kept), F.expr("if(found IS NULL, 0L, cast(size(found) AS bigint))").alias("n_entities"), F.expr(kinds).alias("entity_kinds"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: doc_id, n_entities, entity_kinds and the text with surrogates."""
    out = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key="tessera")
    return out.select("doc_id", "n_entities", "entity_kinds", "text")
