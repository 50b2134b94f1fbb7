"""Template residue, filler and error pages in place of content.

Method: one automaton marks the texts that hold any delimiter or tell-tale word; only
those are read by the grammars, one regular expression for each placeholder delimiter and
one for each family of notices. Placeholders in code blocks are blanked out, those in a
sentence that speaks of templates are discounted unless they are dense, and a notice
counts only where little else stands beside it. One pass, no shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A name of a placeholder: words of letters, digits, dots and dashes; of any length, and read once (possessive), so that no text makes the grammars slow.
_NAME = r"\s*+[\w.\-]++(?: ++[\w.\-]++)*+\s*+"
# Placeholder grammars by delimiter, on the text as written.
PLACEHOLDERS = {
    "double brace": r"\{\{\{?\s*+[#/^&>!]?+[\w.\- |:'\"()\t]++\}?\}\}",
    "block tag": r"\{%-?\s*+\w[^%{}\n]*+%\}",
    "page tag": r"<%[=\-#]?+[^%<>\n]++%>",
    "dollar brace": r"\$\{\s*+[A-Za-z_ა-ჰ][\w.\-]*+\s*+\}",
    "hash brace": r"#\{\s*+[A-Za-z_ა-ჰ][\w.\-]*+\s*+\}",
    "percent": r"%%[A-Za-z_][\w.]*+%%|(?<![\w%])%[A-Z][A-Z0-9_]{2,}+%(?![\w%])",
    "double bracket": rf"\[\[{_NAME}\]\]",
    "double at": r"@@[\w.]{2,}+@@",
    "double underscore": r"(?<!\w)__[A-Z][A-Z0-9_]{3,}+(?<=__)(?!\w)",
    "chevrons": rf"<<{_NAME}>>",
    "star bar": r"\*\|[A-Z0-9_:]{2,}+\|\*",
    "single brace": r"(?<![{$#\w])\{(?:\d{1,2}|[a-z]{3,}+|[a-z][a-z0-9]*+(?:[_.][a-z0-9]++)++)\}(?!\})",
    "prompt": r"\[(?=[^\[\]\n]*?(?:(?i:\b(?:your|insert|enter|add|type|fill|specify|write|put|replace)\b|\bhere\b)|ჩაწერეთ|ჩასვით|დაამატეთ|შეიყვანეთ|მიუთითეთ|შეავსეთ|თქვენი))[^\[\]\n]{3,}+\]",
}
_PLACEHOLDER = re.compile("|".join(f"(?:{p})" for p in PLACEHOLDERS.values()))
_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|<(pre|code|script|style)\b[^<>]*+>.*?(?:</\1>|\Z)|`[^`\n]++`", re.S | re.I)
_ABOUT = re.compile(r"templat|placeholder|variable|syntax|mustache|jinja|handlebars|snippet|tutorial|for example|e\.g\.|such as|curly|interpolat|შაბლონ|ცვლად|მაგალითად|სინტაქს|ფრჩხილ", re.I)

# Notices by family, on lower-case text.
NOTICES = {
    "scripts": r"(?:enable|turn on|allow|activate|switch on|requires?|needs?|only with) (?:\S+ ){0,3}?(?:javascript|scripts?|cookies)|(?:javascript|scripts?|cookies)\b(?: \S+){0,3}? (?:disabled|turned off|switched off|turned on|blocked|not supported|is required to)|has them switched off|turn it on and reload|(?:turn|switch) (?:it|them) on|loading\s?(?:\.\.\.|…)|(?:ჩართ\S+|გააქტიურ\S+) (?:\S+ ){0,2}?(?:javascript|სკრიპტ|ქუქი)|არ უშვებს სკრიპტ|(?:javascript|სკრიპტ\S*) (?:გამორთულია|გათიშულია)",
    "browser": r"browser (?:\S+ ){0,2}?(?:out of date|outdated|not supported|unsupported|too old)|cannot display this content|ბრაუზერი? (?:\S+ ){0,2}?(?:მოძველ|არ არის მხარდაჭერილი)",
    "access": r"^\W*(?:\S+ ){0,2}?access (?:is )?(?:denied|forbidden|restricted)|do(?:es)? not have (?:permission|access)|not a robot|are you (?:a )?human|verify (?:that )?you are|checking your browser|captcha|^\W*unauthori[sz]ed|წვდომა (?:აკრძალ|შეზღუდ|უარყოფ)\S*|არ ხართ რობოტი|რობოტი არ ხართ|უფლება არ გაქვთ",
    "session": r"session (?:has )?(?:expired|timed out|ended)|(?:sign|log) ?in (?:again|to (?:see|view|continue))|სესიის ვადა ამოიწურა|სესია (?:დასრულდა|ამოიწურა)|(?:გაიარეთ|საჭიროა) ავტორიზაცია",
    "maintenance": r"(?:temporarily|currently) (?:unavailable|down|offline)|^\W*maintenance (?:until|in progress|mode)|(?:under|down for|scheduled) maintenance|under construction|be back (?:soon|shortly)|დროებით (?:მიუწვდომ|შეჩერებ|არ მუშაობს)\S*|(?:მიმდინარეობს|ტარდება) ტექნიკური სამუშაოები",
    "rate": r"too many requests|rate limit|you (?:are|have been) blocked|try again (?:later|in a)|ძალიან ბევრი მოთხოვნა|სცადეთ მოგვიანებით",
    "removal": r"(?:no longer|not) available|(?:was|were|has been|have been) (?:removed|deleted|taken down)|does(?: not|n't) exist|^\W*(?:\S+ ){0,2}?(?:\d{3} )?(?:page )?not found|აღარ (?:არსებობს|არის ხელმისაწვდომი|არის აქტიური)|(?:განცხადება|გვერდი)\S* (?:\S+ ){0,2}?(?:წაშლილია|წაიშალა|ვერ მოიძებნა|მოხსნილია)|ვერ მოიძებნა",
    "server": r"^\W*(?:\S+ ){0,2}?(?:internal )?server error|bad gateway|gateway time-?out|^\W*(?:http )?(?:error|შეცდომა) \d{3}\b|something went wrong|(?:fatal|parse|runtime|syntax) error|^\W*(?:\S+ ){0,1}?warning: \w+|expects parameter|on line \d+|\(line \d+\)|^\W*at [\w$.]+\.[\w$]+(?:\(| |$)|traceback \(|unhandled exception|exception in thread|(?:connection|query|database)\b(?: \S+){0,4}? (?:failed|refused|timed out|lost)|undefined undefined|\[object object\]|\bnan \w+|/ undefined|სერვერმა პასუხი|სერვერის შეცდომა|მოხდა შეცდომა|შეცდომა მოხდა",
}
_NOTICE = re.compile("|".join(f"(?:{p})" for p in NOTICES.values()))
_FILLER = re.compile(r"(?:description|text|content|details|information)(?: is)? (?:coming soon|goes here|here|to be added|to follow)|your (?:content|text|description|title) (?:goes )?here|sample text(?: goes)? here|placeholder text|click to edit|ტექსტი მალე|(?:აქ|აქ) იქნება (?:ტექსტი|აღწერა)|აღწერა მალე|ტექსტის ნიმუში|მალე დაემატება")
# Words around a page's content that are no content.
_FRAME = re.compile(r"©.*|(?:menu|back|home|next|previous|sign in|sign up|log in|login|register|contact(?: us)?|jobs|terms of use|privacy(?: policy)?|cookies|sorry|notice|attention|მთავარი|ვაკანსიები|კონტაქტი|შესვლა|რეგისტრაცია|უკაცრავად|მენიუ|უკან|წესები)(?:\s*+[|·•/,:]\s*|$)")
# Words of the customary Latin filler, in alphabetical order.
LATIN = set(
    "ac accumsan ad adipiscing aenean aliqua aliquam aliquet aliquip amet anim ante arcu at auctor augue aute bibendum blandit cillum commodo condimentum congue consectetur consequat convallis cras culpa cupidatat curabitur cursus dapibus deserunt diam dictum dignissim do dolor dolore donec dui duis ea efficitur egestas eget eiusmod eleifend elementum elit enim erat eros esse est et etiam eu euismod ex excepteur exercitation facilisis fames faucibus felis fermentum feugiat finibus fringilla fugiat fusce gravida habitant hendrerit iaculis id imperdiet in incididunt integer interdum ipsum irure justo labore laboris laborum lacinia lacus laoreet lectus leo libero ligula lobortis lorem luctus maecenas magna malesuada massa mattis mauris maximus metus mi minim molestie mollis mollit morbi nam nec neque nibh nisi nisl non nostrud nulla nullam nunc occaecat odio officia orci ornare pariatur pellentesque pharetra phasellus placerat porta porttitor posuere praesent pretium proident proin pulvinar purus quam qui quis quisque reprehenderit rhoncus risus rutrum sagittis sapien scelerisque sed sem semper senectus sint sit sodales sollicitudin suscipit suspendisse tellus tempor tempus tincidunt tortor tristique turpis ullamco ultrices ultricies urna ut varius vehicula vel velit veniam venenatis vestibulum vitae vivamus viverra volutpat voluptate vulputate".split()
)
#: Latin words running from which they are filler, and words typed without looking; words of a repeated phrase, and its times, from which it is; times a filler sentence is said.
LATIN_RUN, MASH_RUN, CYCLE_WORDS, CYCLE_TIMES, FILLER_TIMES = 8, 6, 8, 4, 3
#: A notice counts if at most this many words stand beside it that are neither notice nor page frame.
BESIDE = 10
_DELIMITER = re.compile(r"[{\[]|%[%A-Z]|<<|<%|@@|__|\*\|")
_SENTENCE = re.compile(r"(?:[^.!?…\n]|[.!?…](?!\s|$))+[.!?…]*")
_INVISIBLE = re.compile(r"[​-‏⁠﻿­]")
_MASH = ("xxx", "asdf", "qwer", "zxcv", "test", "ტესტ", "blah", "aaa", "goes here", "content here", "იქნება ტექსტი", "coming soon")
_MASHED = re.compile(r"(\w)\1{2,}|(?:asdf|qwer|zxcv)\w*")
_FILLER_WORDS = ("coming soon", "content", "here", "sample text", "placeholder", "click to edit", "to be added", "to follow", "მალე", "იქნება", "ნიმუში")
# Parts of notices of which each has one: what sends a sentence to the grammars.
_TELLING = "script cookie browser robot denied forbidden restricted permission session sign log unavailable offline maintenance construction available removed deleted exist found error wrong warning exception traceback failed refused timed undefined object] nan loading human captcha gateway unauthor blocked requests rate try verify down expects line back access lost სკრიპტ ქუქი javascript ბრაუზერ წვდომა რობოტ სესი ავტორიზაცია მიუწვდომ სამუშაოები ვერ აღარ შეცდომ სერვერ წაშლილ წაიშალა მოხსნილ უფლება შეჩერებ მუშაობს მოთხოვნა სცადეთ at turn switch".split()

_automaton = None


def _telling():
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for t in [*_TELLING, *_FILLER_WORDS]:
            _automaton.add_word(t, t)
        _automaton.make_automaton()
    return _automaton


def _placeholder(text: str) -> bool:
    shown = _CODE.sub(lambda m: " " * len(m[0]), text) if "`" in text or "~~~" in text or "<" in text else text
    marks = list(_PLACEHOLDER.finditer(shown))
    if not marks:
        return False
    if sum(len(m[0]) for m in marks) * 4 > len(shown):
        return True
    near = lambda m: max(0, m.start() - 120)
    around = (shown[max(near(m), shown.rfind("\n", near(m), m.start())) : m.start()] + " " + shown[m.end() : m.end() + 80].split("\n")[0] for m in marks)
    return not all(_ABOUT.search(a) for a in around)


def _cyclic(words: list[str]) -> bool:
    """Whether a phrase of up to eight words is said over and over."""
    for period in range(1, 9):
        same = 0
        for a, b in zip(words, words[period:], strict=False):
            same = same + 1 if a == b else 0
            if same >= max(CYCLE_WORDS, period * (CYCLE_TIMES - 1)):
                return True
    return False


def _filler(low: str) -> bool:
    words = low.split()
    if len(words) > CYCLE_WORDS and (3 * len(set(words)) <= len(words) or any(w in low for w in _MASH)) and _cyclic(words):
        return True
    if any(w in low for w in _MASH[:4]):
        run = 0
        for w in words:
            run = run + 1 if _MASHED.fullmatch(w) else 0
            if run >= MASH_RUN:
                return True
    if "ipsum" in low or "dolor" in low or "lorem" in low:
        run = 0
        for w in words:
            run = run + 1 if w.strip(".,;:!?") in LATIN else 0
            if run >= LATIN_RUN:
                return True
    return any(w in low for w in _FILLER_WORDS) and len(_FILLER.findall(low)) >= FILLER_TIMES


def _notice(low: str) -> str:
    """notice or filler where the text holds little else, else nothing."""
    said = beside = 0
    kind = ""
    for m in _SENTENCE.finditer(low):
        bare = unicodedata.normalize("NFKC", m[0]).strip()
        bare = _FRAME.sub("", bare).strip()
        words = len(bare.split())
        if not words:
            continue
        hit = None
        if next(_telling().iter(bare), None) is not None:
            hit = _NOTICE.search(bare) or _FILLER.search(bare)
        if hit:
            said += words
            kind = "notice" if hit.re is _NOTICE else kind or "filler"
        else:
            beside += words
            if beside > BESIDE:
                return ""
    return kind if said else ""


def reasons(text: str | None) -> list[str]:
    """Why a text is no content: placeholder, filler, notice; empty if it is."""
    if not text:
        return []
    out = ["placeholder"] if _DELIMITER.search(text) and _placeholder(text) else []
    low = _INVISIBLE.sub("", text.lower())
    if _filler(low):
        out.append("filler")
    kind = _notice(low)
    if kind and kind not in out:
        out.append(kind)
    return out


def residue(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(`key`, reasons): the rows whose text has residue in place of content, with why.

    Whole texts are read. A null, empty or blank text has no residue and no row; repeated
    rows give repeated rows; other columns are ignored. Exclude the result with a left
    anti join on `key`.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            why = [reasons(t) for t in batch.column("t").to_pylist()]
            keep = [i for i, w in enumerate(why) if w]
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(keep, pa.int64())), pa.array([why[i] for i in keep], pa.list_(pa.string()))], names=["k", "why"])

    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"k {kind}, why array<string>").select(F.col("k").alias(key), F.col("why").alias("reasons"))
