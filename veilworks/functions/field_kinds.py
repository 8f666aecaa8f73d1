"""Which kind of personal or secret data a field name announces.

The rules are data: an ordered list, first match wins. The same list yields the Spark expression and
the SQL text used by the checks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V


@dataclass(frozen=True)
class FieldRule:
    kind: str | None
    names: list[str] = field(default_factory=list)  # whole name
    words: list[str] = field(default_factory=list)  # anywhere in the name
    pattern: str = ""  # anything the two lists cannot say
    word_without: tuple[str, str] | None = None  # first part anywhere, second part nowhere
    unless: str = ""  # a name the word list must not claim


def _normal(names: list[str]) -> list[str]:
    return [n for n in names if "-" not in n]


DEFAULT_RULES = [
    FieldRule(None, names=_normal(V.SOURCE_FIELDS) + _normal(V.DESTINATION_FIELDS)),
    FieldRule("STORE_CODE", words=V.STORE_CODE_WORDS),
    FieldRule("STORE", words=V.STORE_WORDS),
    FieldRule(
        "PERSON",
        names=["name", "ssun"],
        words=V.PERSON_WORDS,
    ),
    FieldRule("EMAIL", words=V.EMAIL_WORDS),
    FieldRule("PHONE", words=V.PHONE_WORDS, unless="ldap_tel"),
    FieldRule("ADDRESS", words=V.ADDRESS_WORDS, word_without=("addr", "ip")),
    FieldRule("MAC_ADDRESS", pattern="^mac$|^mac_|_mac$"),
    FieldRule("IP_ADDRESS", words=V.IP_WORDS, pattern="^ip$|_ip$|^ip_"),
    FieldRule("SECRET", names=["payload", "reassembled"], words=V.SECRET_WORDS),
    FieldRule("DEPARTMENT", names=["ldap_tel", "ssdn"], words=V.DEPARTMENT_WORDS),
    FieldRule("ORGANIZATION", names=["sssdn", "ssdbn"], words=V.ORGANIZATION_WORDS),
    FieldRule("USER_ID", names=V.USER_ID_NAMES, words=V.USER_ID_WORDS),
    FieldRule("EMPLOYEE_ID", words=V.EMPLOYEE_ID_WORDS),
    FieldRule("HOST", names=V.HOST_NAMES, words=V.HOST_WORDS),
    FieldRule("FILE_PATH", names=["path"], words=V.FILE_PATH_WORDS),
    FieldRule("IDENTIFIER", names=V.IDENTIFIER_NAMES, words=V.IDENTIFIER_WORDS),
]


def _words(words: list[str]) -> str:
    """One pattern for "contains any of": words share their beginnings, and a word that another one starts
    with stands for both."""
    if "" in words:
        return ""
    by_first: dict[str, list[str]] = {}
    for w in words:
        by_first.setdefault(w[0], []).append(w[1:])
    parts = [first + _words(rest) for first, rest in by_first.items()]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def _regex(rule: FieldRule) -> str:
    parts = [f"^(?:{'|'.join(rule.names)})$"] if rule.names else []
    if rule.words:
        parts.append(_words(rule.words))
    if rule.pattern:
        parts.append(rule.pattern)
    return "|".join(parts)


def _any_rule(rules: list[FieldRule]) -> str:
    """What a name must contain for any rule with a kind to apply: one test that most names fail."""
    named = [r for r in rules if r.kind]
    words = [w for r in named for w in r.words] + [r.word_without[0] for r in named if r.word_without]
    names = [n for r in named for n in r.names]
    parts = [_words(words)] if words else []
    parts += [f"^(?:{'|'.join(names)})$"] if names else []
    return "|".join(parts + [r.pattern for r in named if r.pattern])


def _decide(name: str, rules: list[FieldRule]) -> str | None:
    """The rules applied to one name, here, to prepare the table of common names."""
    for r in rules:
        hit = name in r.names or any(w in name for w in r.words) or bool(r.pattern and re.search(r.pattern, name))
        if r.word_without:
            hit = hit or (r.word_without[0] in name and r.word_without[1] not in name)
        if hit and name != r.unless:
            return r.kind
    return None


def _common_names(rules: list[FieldRule]) -> dict[str | None, list[str]]:
    """Names that a rule spells out, with their kind: found by hash before any pattern is tried."""
    out: dict[str | None, list[str]] = {}
    for name in dict.fromkeys(n for r in rules for n in r.names + r.words):
        out.setdefault(_decide(name, rules), []).append(name)
    return out


def normalize(name: Column) -> Column:
    return F.lower(F.translate(name, "-.", "__"))


def kind_of(normalized: Column, rules: list[FieldRule] | None = None) -> Column:
    """Kind of a normalised field name, NULL for none."""
    rules = rules or DEFAULT_RULES
    chain = F.when(normalized.isNull(), F.lit(None).cast("string"))
    for kind, names in _common_names(rules).items():
        chain = chain.when(normalized.isin(names), F.lit(kind))
    chain = chain.when(~normalized.rlike(_any_rule(rules)), F.lit(None))
    for rule in rules:
        test = normalized.rlike(_regex(rule))
        if rule.word_without:
            word, without = rule.word_without
            test = test | (normalized.contains(word) & ~normalized.contains(without))
        if rule.unless:
            test = test & (normalized != rule.unless)
        chain = chain.when(test, F.lit(rule.kind))
    return chain


def kind_sql(normalized: str, rules: list[FieldRule] | None = None) -> str:
    """The same decision as a SQL CASE, for result checks in another engine."""
    out = ["CASE"]
    for rule in rules or DEFAULT_RULES:
        test = f"regexp_matches({normalized}, '{_regex(rule)}')"
        if rule.word_without:
            word, without = rule.word_without
            test = f"({test} OR (contains({normalized}, '{word}') AND NOT contains({normalized}, '{without}')))"
        if rule.unless:
            test += f" AND {normalized} <> '{rule.unless}'"
        out.append(f"WHEN {test} THEN " + (f"'{rule.kind}'" if rule.kind else "NULL"))
    return " ".join(out) + " END"
