"""Masking and tokenising of messages, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rule sets by name, each rule a pattern and its replacement, in the order they apply.
RULES: dict[str, list[tuple[str, str]]] = {
    "hdfs": [(r"blk_[-]{0,1}[0-9]+", "*"), (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "*")],
    "iaas": [
        (r"\d+(.)?\d*\s?GB", "<size1>"),
        (r"\d+(.)?\d*\s?MB", "<size2>"),
        (r"\d+(.)?\d*\s?VCPU", "<size3>"),
        (r"\d+(.)?\d*\s?CPU", "<size4>"),
        (r"\d{1,}\.\d{1,}\.\d{1,}\.\d{1,}", "<ip>"),
        (r"-\s-", "<nothing>"),
        (r"[\:\=]{1}\s?[\d]+", ":<param>"),
        (r"/(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+", "<url>"),
    ],
    "paas": [
        (r"[\*]+", "<lines>"),
        (r"=\d+", "=*"),
        (r"\d{1,}\.\d{1,}\.\d{1,}\.\d{1,}", "<ip>"),
        (r"localhost", "<ip>"),
        (r"-\s\d+\s-", "*"),
        (r"TransactionID=[\w]*", "*"),
        (r"InstanceID=[\w]*", "*"),
        (r"ObjectID=[\w]*", "*"),
        (r"ObjectType=[\w]*", "*"),
        (r"File\s\".*\"", "File:file_path"),
        (r"u\'.*\'", "*"),
        (r"=>\s\{.*", "=><param>"),
        (r"Region\(.*\)", "Region:Region_param"),
    ],
    "generic": [(r"\d{9}", "digit_*"), (r"\d+", "digit_*")],
}
# Fixed value: the characters that make a token special.
SPECIAL = "#$&'*+,/<=>@^_`|~)"
_SPECIAL = r"[#$&'*+,/<=>@^_`|~)]"
# Fixed value: a word with special characters at its end only.
_TAIL = r"^[\w]+[#$&'*+,\/<=>@^_`|~.]+$"


def register_rules(name: str, rules: list[tuple[str, str]]) -> None:
    """Make a rule set known by name to ``mask``; a set of that name is replaced."""
    for pattern, _ in rules:
        re.compile(pattern)
    RULES[name] = list(rules)


def read_rules(lines: list[str]) -> list[tuple[str, str]]:
    """Rules of a rule file: two fields a line, parted by one blank. Blank lines are skipped, longer ones keep two fields."""
    out = []
    for line in lines:
        fields = line.rstrip("\n").split(" ")
        if line.strip():
            if len(fields) < 2:
                raise ValueError(f"a rule needs a pattern and a replacement: {line!r}")
            re.compile(fields[0])
            out.append((fields[0], fields[1]))
    return out


def mask(message: Column, rules: str | list[tuple[str, str]]) -> Column:
    """The message with blanks unified and the rules applied in order; ``.`` also matches line ends."""
    for pattern, by in [(r"\s+", " "), *(RULES[rules] if isinstance(rules, str) else rules)]:
        message = F.regexp_replace(message, f"(?s){pattern}", by.replace("\\", "\\\\").replace("$", "\\$"))
    return message


def tokenize(masked: Column) -> Column:
    """Tokens between blanks and dots, empty ones included."""
    return F.split(masked, r" |\.", -1)


def stripped_words(message: Column) -> Column:
    """Words of the message without its digits; no empty ones."""
    return F.filter(F.split(F.regexp_replace(message, "[0-9]+", ""), r"\s+"), lambda x: x != "")


def has_digit(token: Column) -> Column:
    """Whether the token holds a digit of any script."""
    return token.rlike(r"(?U)\d")


def has_special(token: Column) -> Column:
    """Whether the token holds one of ``SPECIAL``."""
    return token.rlike(_SPECIAL)


def has_special_tail(token: Column) -> Column:
    """Whether the token holds a special character other than at the end of a word."""
    return has_special(token) & ~token.rlike(_TAIL)


def clean(token: Column) -> Column:
    """Neither digits nor special characters."""
    return ~has_digit(token) & ~has_special(token)


def key_layer(tokens: Column, fallback: str = "") -> Column:
    """``struct<pos, key>``: the bucket of a token list by its length and its first, else last, clean token."""
    n, first, last = F.size(tokens), tokens[0], F.element_at(tokens, -1)
    return (
        F.when(clean(first), F.struct((n * 3).alias("pos"), first.alias("key")))
        .when(clean(last), F.struct((n * 3 + 1).alias("pos"), last.alias("key")))
        .otherwise(F.struct((n * 3 + 2).alias("pos"), F.lit(fallback).alias("key")))
    )


def is_float(token: Column) -> Column:
    """Whether the token reads as a number."""
    return token.try_cast("double").isNotNull()


def collapse_stars(template: Column) -> Column:
    """Runs of ``*`` as one; a word that ends in ``*`` swallows the run after it."""
    return F.trim(F.regexp_replace(F.concat(template, F.lit(" ")), r"(\* )+", "* "))
