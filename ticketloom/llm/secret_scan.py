"""Secret scan with a trigram index (native: DataFrame functions only on the executors).

Each rule's regex is parsed on the driver into a Boolean trigram query: an AND of ORs of strings that every match must
hold; of a string's trigrams the index has the `_RAREST` rarest ones, by the frequency of letters. One pass over a
text, by one regex that tries all indexed trigrams at each place, gives the text's postings: the set of them that it
holds. Postings stay in the text's own row, so a rule's query intersects and unites them
there; no text is shuffled or joined. Texts that satisfy a rule's query are verified with the regex itself. A
rule from which no trigram follows (a run of hex digits) is run over every text. Letters A-Z count as a-z in trigrams.

Spans are code point offsets, found by splitting at the matches and adding up lengths, a block of matches at a time.

Defined results:
- null or empty text: no spans. Very long texts are scanned whole, with any number of matches. Repeated rows are scanned
  alike, null ids like others; an empty table gives an empty result. Extra columns with any name are kept apart in a
  struct and come back unchanged from redact_secrets.
- overlapping spans of different kinds are all reported; redaction merges them.
- a private key goes up to its END line; without one, up to the first blank or other character not of base64.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as rc, _parser as rp

from pyspark.sql import Column, DataFrame, functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)
#: Blank and letters from the most to the least common in running text; all else is rarer.
_COMMON = " etaoinshrdlcumwfgypbvkjxqz"
_RAREST = 2
#: Matches whose places are added up at once.
_BLOCK = 256


@dataclass(frozen=True)
class SecretRule:
    kind: str
    pattern: str
    #: Group whose length counts (0: the whole match), and its least length.
    group: int = 0
    least: int = 1
    ignore_case: bool = False
    base: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


#: Base kinds in their order, then the kinds that the method adds.
RULES = (
    SecretRule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, True),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20, False, True),
    SecretRule("hex", r"[0-9a-f]{24,}", 0, 24, False, True),
    SecretRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----([A-Za-z0-9+/=\x20\x09-\x0D]*-----END [A-Z ]*PRIVATE KEY-----|[A-Za-z0-9+/=\x09-\x0D]*)"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    SecretRule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("cloud_key", r"AIza[A-Za-z0-9_-]{35,}"),
    SecretRule("url_login", r"://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!-]{4,}@[A-Za-z0-9.-]+"),
)
_MOST_STRINGS = 64


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """AND of ORs: each set names alternatives of which every match holds one (A-Z as a-z).

    A member is a literal string of three characters or more; it stands for the AND of its trigrams.
    """

    def exact(tree) -> set[str] | None:
        """All strings that the tree can match, if few."""
        got = {""}
        for op, arg in tree:
            if op is rc.LITERAL:
                own = {chr(arg)}
            elif op is rc.IN and all(o is rc.LITERAL for o, _ in arg) and len(arg) <= 16:
                own = {chr(a) for _, a in arg}
            elif op is rc.SUBPATTERN:
                own = exact(arg[3])
            elif op is rc.BRANCH:
                parts = [exact(x) for x in arg[1]]
                own = None if any(p is None for p in parts) else set().union(*parts)
            elif op is rc.MAX_REPEAT and arg[1] <= 2:
                one = exact(arg[2])
                own = None if one is None else set()
                for n in range(arg[0], arg[1] + 1) if one is not None else ():
                    more = {""}
                    for _ in range(n):
                        more = {a + b for a in more for b in one}
                    own |= more
            else:
                own = None
            if own is None:
                return None
            got = {a + b for a in got for b in own}
            if len(got) > _MOST_STRINGS:
                return None
        return got

    clauses: list[set[str]] = []
    run = {""}

    def close():
        nonlocal run
        if all(len(s) >= 3 for s in run):
            clauses.append({s.translate(_FOLD) for s in run})
        run = {""}

    for node in rp.parse(pattern):
        own = exact([node])
        if own is not None and len(run) * len(own) <= _MOST_STRINGS:
            run = {a + b for a in run for b in own}
        else:
            close()
            if own is not None:
                run = own
            elif node[0] is rc.SUBPATTERN:
                clauses.extend(set(c) for c in trigram_query_of_tree(node[1][3]))
            elif node[0] is rc.MAX_REPEAT and node[1][0] >= 1:
                clauses.extend(set(c) for c in trigram_query_of_tree(node[1][2]))
    close()
    # A string that holds another alternative adds nothing.
    return [frozenset(s for s in c if not any(t != s and t in s for t in c)) for c in clauses]


def trigram_query_of_tree(tree) -> list[frozenset[str]]:
    """As trigram_query, for a part of a parsed regex that occurs at least once."""
    return trigram_query_from_nodes(list(tree))


def trigram_query_from_nodes(nodes) -> list[frozenset[str]]:
    out = []
    for op, arg in nodes:
        if op is rc.SUBPATTERN:
            out += trigram_query_from_nodes(list(arg[3]))
    literal = ""
    for op, arg in [*nodes, (None, None)]:
        if op is rc.LITERAL:
            literal += chr(arg)
            continue
        if len(literal) >= 3:
            out.append(frozenset({literal.translate(_FOLD)}))
        literal = ""
    return out


def trigrams(s: str) -> list[str]:
    """The rarest trigrams of a string, as the index has them."""
    own = sorted({s[i : i + 3] for i in range(len(s) - 2)})
    return sorted(own, key=lambda g: sum(map(_COMMON.find, g)) + sum(len(_COMMON) for c in g if c not in _COMMON), reverse=True)[:_RAREST]


SPANS = "array<struct<start:int,ord:int,kind:string,end:int>>"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans_of(text: Column, rule: SecretRule, order: int) -> Column:
    """array<struct<start, ord, kind, end>> of the rule's matches, leftmost and not overlapping; short ones dropped."""
    pattern = F.lit(rule.java)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    sizes = lambda strings: F.transform(strings, lambda s: F.length(s))
    # The text before each match, the match, the part that counts: lengths only.
    triples = F.arrays_zip(F.slice(sizes(F.split(text, rule.java, -1)), 1, F.size(found)).alias("gap"), sizes(found).alias("m"), sizes(part).alias("g"))

    def one(at: Column, t: Column) -> Column:
        start = at + t["gap"]
        return F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), (start + t["m"]).alias("end"))

    def step(acc: Column, t: Column) -> Column:
        out = F.when(t["g"] >= rule.least, F.concat(acc["out"], F.array(one(acc["at"], t)))).otherwise(acc["out"])
        return F.struct((acc["at"] + t["gap"] + t["m"]).alias("at"), out.alias("out"))

    def of_block(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(SPANS).alias("out")), step, lambda acc: acc["out"])

    def of_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, t: a + t["gap"] + t["m"]))
        starts = F.aggregate(totals, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return F.flatten(F.zip_with(blocks, let(starts, lambda a: F.slice(a, 1, F.size(a) - 1)), of_block))

    # Appending copies what is there, so only a block's spans, and the blocks' places, are appended to.
    blocks = lambda t: F.transform(F.sequence(F.lit(0), F.floor((F.size(t) - 1) / _BLOCK).cast("int")), lambda b: F.slice(t, b * _BLOCK + 1, F.lit(_BLOCK)))
    return let(triples, lambda t: F.when(F.size(t) <= _BLOCK, of_block(t, F.lit(0))).otherwise(let(blocks(t), of_blocks)))


def posting_pattern(grams: list[str]) -> str:
    """A regex without width whose first group is one of the trigrams, in either case. Three classes rule out most places;
    then the trigrams of one beginning share it."""

    def cls(chars) -> str:
        return "[" + "".join(c + c.upper() if c in _LOWER else c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in sorted(set(chars))) + "]"

    tree: dict[str, dict[str, str]] = {}
    for a, b, c in sorted(grams):
        own = tree.setdefault(a, {})
        own[b] = own.get(b, "") + c
    second = lambda t: "|".join(cls(b) + cls(cs) for b, cs in t.items())
    return "(?=" + "".join(map(cls, zip(*grams))) + ")(?=(" + "|".join(f"{cls(a)}(?:{second(t)})" for a, t in tree.items()) + "))"


def postings(text: Column, rules=RULES) -> Column:
    """The indexed trigrams of any rule that the text holds: one pass over it."""
    grams = sorted({g for r in rules for clause in trigram_query(r.pattern) for s in clause for g in trigrams(s)})
    if not grams:
        return F.array().cast("array<string>")
    held = F.regexp_extract_all(text, F.lit(posting_pattern(grams)), F.lit(1))
    return F.array_distinct(F.transform(held, lambda g: F.translate(g, _UPPER, _LOWER)))


def satisfies(held: Column, rule: SecretRule) -> Column:
    """Whether postings satisfy the rule's trigram query; true for a rule without one."""
    test = F.lit(True)
    for clause in trigram_query(rule.pattern):
        any_of = F.lit(False)
        for s in sorted(clause):
            all_of = F.lit(True)
            for g in trigrams(s):
                all_of = all_of & F.array_contains(held, g)
            any_of = any_of | all_of
        test = test & any_of
    return test


def secret_spans(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """docs as _row (struct), _text and _spans, sorted by start and kind."""
    x = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    x = x.select("*", postings(F.col("_text"), rules).alias("_held"))
    # Which rules' queries hold, from the postings alone; then the candidates are verified.
    x = x.select("_row", "_text", F.array(*[satisfies(F.col("_held"), r) for r in rules]).alias("_rules"))
    found = [F.when(F.get("_rules", F.lit(i)) & F.col("_text").rlike(r.java), spans_of(F.col("_text"), r, i)).otherwise(F.array().cast(SPANS)) for i, r in enumerate(rules)]
    return x.select("_row", "_text", F.sort_array(F.concat(*found)).alias("_spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact_secrets(docs: DataFrame, rules=RULES, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with each run of overlapping spans in text_col replaced by `mark`; other texts and columns unchanged."""
    x = secret_spans(docs, rules, text_col)
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substr(F.col("_text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit(mark)).alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        )

    clean = F.aggregate("_spans", state, step, lambda acc: F.concat(acc["out"], F.substr(F.col("_text"), acc["at"] + 1, F.length("_text"))))
    text = F.when(F.size("_spans") > 0, clean).otherwise(F.col(f"_row.`{text_col}`"))
    return x.withColumn("_new", text).select(*[F.col("_new").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
