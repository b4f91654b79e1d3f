"""Cell metrics in plain Python, written from the rules, for comparison."""

from __future__ import annotations

import itertools
import re

from nbgauge.functions.code import KEYWORDS, OPERATORS

WORD_CHARS = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def names_in(text):
    """Maximal word runs without leading digits, keywords left out."""
    found = []
    for is_word, run in itertools.groupby(text, key=lambda ch: ch in WORD_CHARS):
        if is_word:
            name = "".join(run).lstrip("0123456789")
            if name and name not in KEYWORDS:
                found.append(name)
    return found


def pieces_of(text):
    single = set("-()+*/=&|^~<>%")
    starts = ["!=", *["\n    " + op for op in ("**", ">>", "+=", "//=", "==")]]
    pieces, piece, i = [], "", 0
    while i < len(text):
        step = 1 if text[i] in single else next((len(s) for s in starts if text.startswith(s, i)), 0)
        if step:
            pieces.append(piece)
            piece, i = "", i + step
        else:
            piece += text[i]
            i += 1
    return [p for p in [*pieces, piece] if p]


def parameter_count(text):
    total, i = 0, 0
    while (call := next_call(text, i)) is not None:
        start, end = call
        last_line = text[start : end + 1].split("\n")[-1]
        if "(" not in last_line:
            return 0
        total += last_line[last_line.index("(") :].count(",") + 1
        i = end + 1
    return total


def next_call(text, i):
    while True:
        opening = text.find("(", i)
        if opening < 0:
            return None
        run_start = opening
        while run_start > 0 and text[run_start - 1] in WORD_CHARS:
            run_start -= 1
        if not text[run_start:opening].lstrip("0123456789"):
            i = opening + 1
            continue
        closing = text.find(")", opening)
        return None if closing < 0 else (opening, closing)


def import_list(text, strict=True):
    # Fixed value: the pattern is that of the published metric.
    groups = [m.group(1) for m in re.finditer(r"(?m)^\s*(?:from|import)\s+(\w+(?:\s*,\s*\w+)*)", text)]
    if not strict:
        return [n.strip() for g in groups for n in g.split(",")]
    kept, split, skip = [], [], False
    for group in groups:
        if "," in group and not skip:
            split += group.replace(" ", "").split(",")
            skip = True
        else:
            kept.append(group)
            skip = False
    return kept + split


def block_lines(text):
    total, i = 0, 0
    while True:
        starts = [p for q in ("'''", '"""') for p in range(i, len(text)) if text.startswith(q, p) and (p == 0 or text[p - 1] == "\n")]
        for start in sorted(starts):
            quote, end = text[start : start + 3], start + 3
            while (end := text.find(quote, end)) >= 0:
                rest = text[end + 3 :]
                if re.match(r"\s*\n", rest) or rest == "" or rest[0] == "\n":
                    break
                end += 1
            if end >= 0:
                total += text[start : end + 3].count("\n") + 1
                i = end + 3
                break
        else:
            return total


def code_metrics(text):
    rows = text.split("\n")
    names = names_in(text)
    per_line = [n for n in (len(names_in(r)) for r in dict.fromkeys(rows)) if n]
    pieces = pieces_of(text)
    remarks = [r.split("#", 1)[1] for r in rows if "#" in r]
    return {
        "LOC": len(rows),
        "BLC": 0,
        "UDF": sum("def " in r and r[0] != "#" for r in rows),
        "I": text.count("import "),
        "EH": text.count("try:"),
        "ALLC": sum(map(len, rows)) / len(rows),
        "S": sum(text.count(w) for w in ("while", "for", "if")),
        "P": parameter_count(text),
        "KLCID": sum(per_line) / len(per_line) if per_line else 0.0,
        "NBD": text.count(" ") / len(rows),
        "OPRATOR": sum(map(text.count, OPERATORS)),
        "UOPRATOR": sum(op in text for op in OPERATORS),
        "OPRND": len(pieces),
        "UOPRND": len(set(pieces)),
        "ID": len(names),
        "ALID": sum(map(len, names)) // len(names) if names else 0,
        "MLID": max(map(len, names), default=0),
        "LOCom": block_lines(text) + sum(1 for r in remarks if r),
        "CW": sum(len(r.split()) for r in remarks),
        "API": import_list(text),
    }


def markdown_metrics(text):
    def headers(level):
        mark = "#" * level + " "
        return int(text.startswith(mark)) + sum(
            text[i] in " \n" and text.startswith(mark, i + 1) for i in range(len(text))
        )

    return {"LMC": text.count("\n") + 1, "MW": len(text.split()), **{f"H{n}": headers(n) for n in (1, 2, 3)}}
