"""URL filter: glob rules as a multiword Shift-And automaton.

Every rule becomes a row of states in one bit vector of several 64-bit words. A
character moves all states of all rules at once: a state is entered from the one
before it if the character is in its class, and a wildcard's state is kept while
characters stay in the wildcard's class. URLs of a batch advance together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from witnesslake.llm.common import lower_ascii, small_batches

#: The rules of the filter and its verdict where none fits: fixed values.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
OTHERWISE = "allow"
SLASH = ord("/")
#: Characters after which subjects that are settled are left out.
SWEEP = 16


@dataclass
class Automaton:
    """Masks by byte: enter[c] states that c may enter, stay[c] states that c may keep; start and accept states."""

    enter: np.ndarray
    stay: np.ndarray
    start: np.ndarray
    accept: list[tuple[int, np.uint64]]


def compile_globs(globs: list[str]) -> Automaton:
    """`*` stands for any run without a slash, `**` for any run, `?` for one character but a slash; all else for itself."""
    states: list[tuple[set[int], set[int], bool]] = []  # entered by, kept by, is a start
    ends, every, no_slash = [], set(range(256)), set(range(256)) - {SLASH}
    for glob in globs:
        states.append((set(), set(), True))
        at, data = 0, glob.encode()
        while at < len(data):
            if data[at : at + 2] == b"**":
                states[-1][1].update(every)
                at += 2
            elif data[at] == ord("*"):
                states[-1][1].update(no_slash)
                at += 1
            elif data[at] == ord("?"):
                states.append((no_slash - set(range(0x80, 0xC0)), set(range(0x80, 0xC0)), False))
                at += 1
            else:
                states.append(({data[at]}, set(), False))
                at += 1
        ends.append(len(states) - 1)
    words = -(-max(1, len(states)) // 64)
    enter, stay, start = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64), np.zeros(words, np.uint64)
    for i, (entered, kept, first) in enumerate(states):
        word, bit = i // 64, np.uint64(1 << i % 64)
        enter[sorted(entered), word] |= bit
        stay[sorted(kept), word] |= bit
        if first:
            start[word] |= bit
    return Automaton(enter, stay, start, [(e // 64, np.uint64(1 << e % 64)) for e in ends])


def _before(states: np.ndarray) -> np.ndarray:
    """The states from which those given are entered."""
    out = states >> np.uint64(1)
    out[:-1] |= states[1:] << np.uint64(63)
    return out


def match(automaton: Automaton, subjects: list[str]) -> np.ndarray:
    """A row a subject, a column a glob: whether the glob matches the whole subject."""
    data = [s.encode() for s in subjects]
    order = sorted(range(len(data)), key=lambda i: -len(data[i]))
    lengths = np.array([len(data[i]) for i in order], np.int64)
    flat = np.frombuffer(b"".join(data[i] for i in order), np.uint8)
    begin = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    state = np.repeat(automaton.start[None], len(data), 0)
    settled = np.bitwise_and.reduce(automaton.stay)  # states that every character keeps
    final = settled & ~_before(np.bitwise_or.reduce(automaton.enter))
    live = np.arange(len(data))
    for t in range(int(lengths[0]) if len(lengths) else 0):
        live = live[lengths[live] > t]
        if t % SWEEP == 0:  # subjects of which nothing but final states is left do not change any more
            live = live[(state[live] & ~final).any(axis=1)]
        if not len(live):
            break
        c, now = flat[begin[live] + t], state[live]
        moved = now << np.uint64(1)
        moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
        state[live] = (moved & automaton.enter[c]) | (now & automaton.stay[c])
    out = np.zeros((len(data), len(automaton.accept)), bool)
    for k, (word, bit) in enumerate(automaton.accept):
        out[order, k] = (state[:, word] & bit) != 0
    return out


def host(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def filter_urls(pages: DataFrame, rules: tuple = RULES, otherwise: str = OTHERWISE) -> DataFrame:
    """page_id, host, path, rule and verdict of each url.

    A rule `host/path` fits its host and all subdomains where the url's path
    starts with the rule's; the longest rule that fits decides, else `otherwise`
    with a null rule. A null url or one without :// has an empty host and path
    and fits no rule; so does an empty path, for rules end their host with a
    slash. Repeated rows stay, an empty table stays empty, other columns are
    ignored.
    """
    small_batches(pages.sparkSession)
    ranked = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    # before the host stands a dot, so one glob fits the host and its subdomains
    automaton = compile_globs([f"*.{rule}**" for rule, _ in ranked])
    names = np.array([r for r, _ in ranked] + [None], dtype=object)
    verdicts = np.array([v for _, v in ranked] + [otherwise], dtype=object)

    @F.pandas_udf("rule string, verdict string")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for subjects in batches:
            hit = match(automaton, subjects.tolist())
            first = np.where(hit.any(axis=1), hit.argmax(axis=1), len(ranked))
            yield pd.DataFrame({"rule": names[first], "verdict": verdicts[first]})

    placed = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    judged = placed.withColumn("j", judge(F.concat(F.lit("."), "host", "path")))
    return judged.select("page_id", "host", "path", "j.rule", "j.verdict")
