"""What models are asked, as columns: instructions and prompts of the seven roles; chat requests and answers as JSON.

Marks and limits must be what the parsers of :mod:`~quire.operators.profile` expect; the wording is free.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from .profile import FIELDS, MARKS, NONE, REVISE, UNKNOWN

#: Characters of a title or heading, and of a neighbouring line, that a prompt shows.
TITLE, NEIGHBOUR = 120, 200
CHOICES = ("A", "B")


def _lines(title: str, lines: Column) -> Column:
    """A titled list; nothing if ``lines`` are null or empty."""
    items = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(F.size(F.coalesce(lines, F.array().cast("array<string>"))) > 0, F.concat(F.lit(f"\n{title}\n"), items)).otherwise("")


def _shown(label: str, c: Column, end: str = "\n") -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c, F.lit(end))).otherwise("")


def _tail(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def glossary_line(term: Column, rendering: Column, note: Column) -> Column:
    """One agreed term as an instruction; a null rendering keeps the term as written."""
    said = F.when(rendering.isNull(), F.concat(F.lit("Keep “"), term, F.lit("” as it is written."))).otherwise(F.concat(F.lit("“"), term, F.lit("” is “"), rendering, F.lit("”.")))
    return F.concat(said, F.when(F.coalesce(note, F.lit("")) != "", F.concat(F.lit(" "), note)).otherwise(""))


def transcription_instructions(language: str) -> Column:
    return F.lit(f"Copy the {language} text of a page as it is printed, in reading order, a paragraph a line. Leave out page numbers and running heads. Write ⍰ for what cannot be read. Answer with the text alone.")


def transcription_prompt(language: str) -> Column:
    return F.lit(f"Copy all {language} text of this page.")


def adjudication_instructions(language: str) -> Column:
    return F.lit(f"Two readers read one block of printed {language} differently. Say which is nearer to the print, not which reads better; where only a digit differs, take A, the recognizer's. Answer A or B.")


def adjudication_prompt(before: Column, a: Column, b: Column) -> Column:
    """Null and empty ``before`` are left out; of a longer one its end is shown."""
    return F.concat(_shown("The block before it:\n", _tail(before, NEIGHBOUR), "\n\n"), F.lit("A: "), a, F.lit("\n\nB: "), b, F.lit("\n\nWhich is nearer to the print, A or B?"))


def profile_instructions(source: str, target: str) -> Column:
    fields = ", ".join(name for name, _ in FIELDS)
    forms = [("kind", "what kind of document it is"), ("field", f"one of {fields}"), ("subject", "what it is about"), ("background", "who is concerned and what happened before"), ("register", f"how the {target} should sound"), ("term", "a term | its rendering everywhere, up to eight lines"), ("note", "what a translator of one sentence would miss, up to three lines")]
    return F.lit(f"Read parts of a document, each headed by its page, before it is translated from {source} into {target}, and say what it is. Answer in these lines alone:\n" + "\n".join(f"{MARKS[k]} {x}" for k, x in forms))


def sample_prompt(sample: Column) -> Column:
    """What the profile, names and questions are asked about."""
    return F.concat(F.lit("Parts of the document, with gaps between them:\n\n"), sample)


profile_prompt = names_prompt = clarification_prompt = sample_prompt


def names_instructions(source: str, target: str, guidance: Column, brief: Column, romanization: str | None = None, limit: int = 20) -> Column:
    rules = [f"Write {UNKNOWN} for a form you are not sure of; an invented one cannot be told from a real one.", "Leave out private persons and ordinary words."]
    rules += [f"{romanization} is no established form; write {UNKNOWN} instead."] if romanization else []
    head = f"Find the names in a {source} document that have an established {target} form: medicines, companies, bodies, statutes, places, works."
    form = f"\nA line each, {limit} at most: {MARKS['name']} name as printed | established form | why\nIf there is none, answer {NONE}.\n" + "\n".join(f"- {r}" for r in rules)
    return F.concat(F.lit(head), _lines("The document:", guidance), _lines("The reader says:", brief), F.lit(form))


def translation_instructions(source: str, target: str, guidance: Column, brief: Column, romanization: str | None = None) -> Column:
    rules = ["Answer with the translation alone: no notes, no announcement, no quotation marks around it.", f"Do not repeat the {source}.", "A heading stays a heading.", f"What has a name in {target} gets that name."]
    rules += [f"{romanization} is no {target}: spell out only what has no name of its own."] if romanization else []
    alone = F.when(F.size(F.coalesce(brief, F.array().cast("array<string>"))) > 0, _lines("The reader asks, above all else:", brief)).otherwise(F.lit(f"\n- Leave no {source} characters."))
    return F.concat(F.lit(f"Translate {source} into {target}.\n" + "\n".join(f"- {r}" for r in rules)), _lines("The document:", guidance), alone)


def translation_context(document: Column, need: Column, previous_source: Column, previous_target: Column, next_source: Column, heading: Column) -> Column:
    """What is shown around a text by its ``need`` (see :func:`quire.operators.context.need`); null if that is nothing."""
    near = F.concat(
        F.when(need["heading"], _shown("Under the heading:\n", F.left(heading, F.lit(TITLE)), "\n\n")).otherwise(""), F.when(need["previous_source"], _shown("The line before:\n", _tail(previous_source, NEIGHBOUR))).otherwise(""),
        F.when(need["previous_target"], _shown("Translated as:\n", _tail(previous_target, NEIGHBOUR))).otherwise(""), F.when(need["following"], _shown("The line after:\n", F.left(next_source, F.lit(NEIGHBOUR)))).otherwise(""),
    )
    near = F.when(near != "", F.concat(near, F.lit("\nNone of this is to be translated.\n\n"))).otherwise("")
    return F.nullif(F.concat(_shown("From a document titled: ", F.left(document, F.lit(TITLE)), "\n\n"), near), F.lit(""))


def translation_prompt(text: Column, kind: Column, context: Column, terms: Column) -> Column:
    """The context, the agreed terms' lines, then the text alone at the end."""
    listed = F.when(F.size(F.coalesce(terms, F.array().cast("array<string>"))) > 0, F.concat(F.lit("For this text:\n"), F.array_join(F.transform(terms, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n\n"))).otherwise("")
    return F.concat(F.coalesce(context, F.lit("")), listed, F.when(kind == "heading", "Translate this heading:\n").otherwise("Translate this text:\n"), text)


def agreed_terms(terms: Column, names: Column, glossary: Column) -> Column:
    """The lines of a prompt's agreed terms: the document's (term, rendering), its names (source, rendering, basis), the
    reader's (term, required, keep); nulls are none."""
    of = lambda c, f: F.transform(c, f)
    none = F.array().cast("array<string>")
    a = of(terms, lambda t: glossary_line(t["term"], t["rendering"], F.lit(None).cast("string")))
    b = of(names, lambda n: glossary_line(n["source"], n["rendering"], n["basis"]))
    c = of(glossary, lambda g: glossary_line(g["term"], F.when(~g["keep"], g["required"]), F.lit(None).cast("string")))
    return F.concat(F.coalesce(a, none), F.coalesce(b, none), F.coalesce(c, none))


def review_instructions(source: str, target: str, guidance: Column, agreed: Column, brief: Column) -> Column:
    head = f"Check a translation from {source} into {target}: meaning, omissions, additions, figures and names, {source} left over, names only spelled out. Style is no fault. Answer\n{MARKS['verdict']} ACCURATE\nor\n{MARKS['verdict']} {REVISE}\n{MARKS['revision']} the corrected translation alone"
    return F.concat(F.lit(head), _lines("The document, whose renderings hold everywhere:", F.concat(guidance, agreed)), _lines("The reader asked:", brief))


def review_prompt(source_name: str, target_name: str, source: Column, draft: Column) -> Column:
    return F.concat(F.lit(source_name + ":\n"), source, F.lit(f"\n\n{target_name}:\n"), draft)


def clarification_instructions(source: str, target: str, limit: int = 3) -> Column:
    return F.lit(f"Before a document is translated from {source} into {target} you may ask up to {limit} questions whose answer would change the translation. Answer in these lines alone, or {NONE}:\n{MARKS['question']} the question\n{MARKS['evidence']} the words that raise it\n{MARKS['option']} label | what a translator should then do")


# --- model servers ---------------------------------------------------------------------------------------------------

#: What an answer, and a list of models, are in each dialect of a model server. Fixed values.
ANSWER = {"ollama": "$.message.content", "openAICompatible": "$.choices[0].message.content"}
LISTED = {"ollama": ("models", "name"), "openAICompatible": ("data", "id")}


def chat_request(dialect: str, model: Column, system: Column, user: Column, temperature: float = 0.0, tokens: Column | int = 512, image: Column | None = None) -> Column:
    """A chat request as JSON; ``image`` is base64, its null rows ask without one."""
    n = tokens if isinstance(tokens, Column) else F.lit(tokens)
    text = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    none = F.lit(None).cast("string")
    if dialect == "ollama":
        none_images = F.lit(None).cast("array<string>")
        own = lambda role, content, images: F.struct(F.lit(role).alias("role"), content.alias("content"), images.alias("images"))
        images = F.when(image.isNotNull(), F.array(image)) if image is not None else none_images
        messages = F.array(own("system", system, none_images), own("user", user, images))
        return F.to_json(F.struct(model.alias("model"), F.lit(False).alias("stream"), messages.alias("messages"), F.struct(F.lit(temperature).alias("temperature"), n.alias("num_predict")).alias("options")))
    if dialect != "openAICompatible":
        raise ValueError(f"no such dialect: {dialect}")
    part = lambda kind, t, url: F.struct(F.lit(kind).alias("type"), t.alias("text"), url.alias("image_url"))
    no_url = F.lit(None).cast("struct<url:string>")
    parts = [part("text", user, no_url)]
    if image is not None:
        parts.append(F.when(image.isNotNull(), part("image_url", none, F.struct(F.concat(F.lit("data:image/png;base64,"), image).alias("url")))))
    asked = F.to_json(F.array_compact(F.array(*parts)))
    head = F.to_json(F.struct(model.alias("model"), F.lit(False).alias("stream"), F.lit(temperature).alias("temperature"), n.alias("max_tokens")))
    messages = F.concat(F.lit(',"messages":['), F.to_json(text("system", system)), F.lit(',{"role":"user","content":'), asked, F.lit("}]}"))
    return F.concat(F.substring(head, F.lit(1), F.char_length(head) - 1), messages)


def chat_answer(dialect: str, body: Column) -> Column:
    """The answer's text in a response; null if there is none or the JSON is broken."""
    return F.get_json_object(body, ANSWER[dialect])


def listed_models(dialect: str, body: Column) -> Column:
    """Names of the models that a server lists; empty if it lists none or the JSON is broken."""
    key, name = LISTED[dialect]
    rows = F.from_json(body, f"{key} array<struct<{name}:string>>")[key]
    return F.coalesce(F.array_compact(F.transform(rows, lambda m: m[name])), F.array().cast("array<string>"))


def attempted(sample: Column, answer: Column, least: int) -> Column:
    """The answer about a document's sample; null where the sample is under ``least`` characters and none is asked for."""
    return F.when(F.char_length(sample) >= least, T.trimmed(answer))


#: Characters of a sample that the profile, the names and the questions need. Fixed values.
LEAST_SAMPLE = {"profile": 60, "names": 60, "questions": 40}
#: The question that is asked of a document whose field is unknown.
FIELD_QUESTION = "What field does the document belong to?"


def document_answers(samples: Column, profile_answer: Column, names_answer: Column, questions_answer: Column, syllables: dict[str, str] | None = None) -> Column:
    """struct(profile, names, questions) that a model's answers about a document come to.

    Short samples are not asked about; a failed call (a null answer) has no profile, names or questions of its own. A
    document of unknown field is asked for it first; three questions at most.
    """
    from .profile import UNSURE, parsed_names, parsed_profile, parsed_questions

    own = lambda role, a: F.coalesce(attempted(samples, a, LEAST_SAMPLE[role]), F.lit(""))
    profile = parsed_profile(own("profile", profile_answer))
    options = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(f"The document's field is {n}.").alias("guidance")) for n, _ in FIELDS], F.struct(F.lit(UNSURE[0]).alias("label"), F.lit(UNSURE[1]).alias("guidance")))
    field = F.array(F.struct(F.lit(FIELD_QUESTION).alias("question"), options.alias("options"), F.lit(None).cast("string").alias("evidence")))

    def told(p: Column, names: Column) -> Column:
        asked = F.concat(F.when(p["field"] == "unknown", field).otherwise(F.slice(field, 1, 0)), parsed_questions(own("questions", questions_answer)))
        asked = F.when(F.char_length(samples) >= LEAST_SAMPLE["questions"], F.slice(asked, 1, 3)).otherwise(F.slice(asked, 1, 0))
        return F.struct(p.alias("profile"), names.alias("names"), asked.alias("questions"))

    return T.let(told, p=profile, names=parsed_names(own("names", names_answer), syllables))
