"""Rules of the basic tiers. Patterns and symbols decide the output."""

BASIC = [
    (r"you are an? expert (in |on |at )?", "§EXP "),
    (r"you are an? ", "§ROLE "),
    (r"please ", "§ACT "),
    (r"return only (the )?code[^.]*\.?", "→code"),
    (r"return as (a )?bullet[- ]?list", "→list"),
    (r"return as (a )?table", "→table"),
    (r"return as json", "→json"),
    (r"step[- ]by[- ]step", "→step"),
    (r"be (very )?concise", "→short"),
    (r"\bsummarize\b", "∑"),
    (r"\bexplain\b", "?"),
    (r"\boptimize\b", "OPT"),
    (r"\bdebug\b", "BUG"),
    (r"\bfix (the |any |a )?bug(s)?\b", "BUG"),
    (r"\bfunction\b", "FN"),
    (r"\bunit test(s)?\b", "TEST"),
    (r"\bdo not\b", "§NOT"),
    (r"\bdon't\b", "§NOT"),
    (r"\bavoid\b", "§NOT"),
    (r"\bcompare\b", "§DIFF"),
    (r"\bpython\b", "py"),
    (r"\bjavascript\b", "js"),
    (r"\btypescript\b", "ts"),
    (r"\bimportant\b", "!!"),
    (r"\breview\b", "«"),
    (r"\bimprove\b", "∆"),
    (r" +", " "),
]

AGGRESSIVE = [
    (r"you are an? expert (in |on |at )?", "§EXP "),
    (r"you are an? ", "§ROLE "),
    (r"please ", ""),
    (r"I need you to ", ""),
    (r"I would like you to ", ""),
    (r"return only (the )?code[^.]*\.?", "→code"),
    (r"step[- ]by[- ]step", "→step"),
    (r"be (very )?concise\.?", "→short"),
    (r"\bsummarize\b", "∑"),
    (r"\bexplain\b", "?"),
    (r"\boptimize\b", "OPT"),
    (r"\bdebug\b", "BUG"),
    (r" +", " "),
]
