"""Language packs as data. The Chinese pack's characters and words are fixed values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pack:
    """What the operators need to know of a source language."""

    name: str
    script: str  # regex class of its script
    romanizable: str = ""
    spaced: bool = True
    stops: str = ".!?"
    stand_alone: str = ""
    closers: str = "\"')]"
    openers: str = "\"'(["
    abbreviations: tuple[str, ...] = ("co", "ltd", "no", "inc", "vs", "etc")
    opens_with_capital: bool = True
    single_letter_initial: bool = True
    expansion: tuple[float, float] = (0.5, 2.0)
    referring: tuple[str, ...] = ()
    continuing: tuple[str, ...] = ()
    false_friends: tuple[str, ...] = ()
    self_contained: int = 20
    numerals: str = ""


CHINESE = Pack(
    name="zh-Hans",
    script=r"\u4E00-\u9FFF\u3400-\u4DBF\uF900-\uFAFF\u2E80-\u2EFF\u3000-\u303F\uFF00-\uFFEF",
    romanizable=r"\u4E00-\u9FFF\u3400-\u4DBF\uF900-\uFAFF",
    spaced=False,
    stops="。！？；….!?",
    stand_alone="。！？；…",
    closers="”’」』）】》\"')]",
    openers="“‘「『（【《\"'([",
    opens_with_capital=False,
    single_letter_initial=False,
    expansion=(0.8, 4.5),
    referring=("该", "上述", "前述", "该等", "前款", "本款", "本条", "本项", "同上", "如前", "上款", "前项", "其中", "此项", "上款所述"),
    continuing=("但", "但是", "并", "并且", "而且", "因此", "所以", "否则", "此外", "同时", "其次", "另外", "如前所述", "为此", "据此"),
    false_friends=("应该", "不该", "活该", "该死"),
    numerals="〇一二三四五六七八九",
)
#: A stand-in for tables without Han text: letters with diacritics are its script.
DIACRITIC = Pack(name="latin-diacritic", script="À-ÿ", romanizable="À-ÿ", expansion=(0.8, 4.5), opens_with_capital=False, single_letter_initial=False, referring=("this", "that"), continuing=("and", "but"), false_friends=("thatch",))
