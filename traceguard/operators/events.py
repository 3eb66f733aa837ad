"""Events to text: foreign spans, prompts, responses, images.

An event is a VARIANT. Where a value of an unexpected shape has to become text, that text is JSON.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traceguard.functions import variants as V
from traceguard.functions.urls import is_public_url
from traceguard.providers import MOST_IMAGE_BYTES

# Roles whose messages are not scanned; images read of one event.
UNSCANNED_ROLES = ("system", "developer")
MOST_IMAGES = 6
MESSAGES = "array<struct<role:string,content:variant>>"


def is_openinference(event: Column) -> Column:
    """An object of attributes, and neither messages nor a response."""
    return F.coalesce((V.kind(V.at(event, "attributes")) == "{") & ~V.truthy(V.at(event, "messages")) & ~V.truthy(V.at(event, "response")), F.lit(False))


def collected_messages(attributes: Column, base: str) -> Column:
    """Messages of dotted keys ``base.N.message.role|content``, in the order of the numbers N."""
    entries = F.map_entries(F.try_variant_get(attributes, "$", "map<string,variant>"))
    pattern = f"^{base.replace('.', '[.]')}[.]([0-9]+)(?:[.](.*))?$"
    found = F.filter(F.transform(entries, lambda e: F.struct(F.regexp_extract(e["key"], pattern, 1).alias("n"), F.regexp_extract(e["key"], pattern, 2).alias("tail"), e["value"].alias("value"))), lambda x: x["n"] != "")

    def gathered(found):
        order = F.array_sort(F.array_distinct(F.transform(found, lambda x: x["n"].cast("long"))))
        value = lambda n, tail: F.get(F.transform(F.filter(found, lambda x: (x["n"].cast("long") == n) & (x["tail"] == tail)), lambda x: x["value"]), 0)
        return F.transform(order, lambda n: F.struct(V.text(value(n, "message.role")).alias("role"), value(n, "message.content").alias("content")))

    return V.let(found, gathered)


def native_messages(event: Column) -> Column:
    """Messages of messages, contents or input: an array of (role, content); a string is one message without a role."""
    source = V.first_true(V.at(event, "messages"), V.at(event, "contents"), V.at(event, "input"))

    def read(source):
        objects = F.filter(V.items(source), lambda m: V.kind(m) == "{")
        listed = F.transform(objects, lambda m: F.struct(V.text(V.at(m, "role")).alias("role"), V.at(m, "content").alias("content")))
        one = F.array(F.struct(F.lit(None).cast("string").alias("role"), source.alias("content")))
        return F.coalesce(F.when(V.kind(source) == '"', one), listed, F.expr(f"cast(array() as {MESSAGES})"))

    return V.let(source, read)


def span_messages(attributes: Column) -> Column:
    """Input messages of a foreign span; else the messages that input.value lists; else it is one user message."""

    def read(parsed):
        listed = F.transform(F.filter(V.items(parsed), lambda m: V.kind(m) == "{"), lambda m: F.struct(V.text(V.at(m, "role")).alias("role"), V.at(m, "content").alias("content")))
        one = F.array(F.struct(F.lit("user").alias("role"), F.try_parse_json(F.to_json(F.struct(V.text(parsed).alias("v")))).alias("content")))
        one = F.transform(one, lambda m: F.struct(m["role"].alias("role"), V.at(m["content"], "v").alias("content")))
        return F.coalesce(listed, one)

    value = V.at(attributes, "input.value")
    given = value.isNotNull() & (V.kind(value) != "n")
    other = F.when(given, V.let(V.maybe_json(value), read)).otherwise(F.expr(f"cast(array() as {MESSAGES})"))
    return V.let(collected_messages(attributes, "llm.input_messages"), lambda c: F.when(F.size(c) > 0, c).otherwise(other))


def span_response(attributes: Column) -> Column:
    """output.value, else the content of the last output message; null without either."""
    value = V.at(attributes, "output.value")
    last = V.let(collected_messages(attributes, "llm.output_messages"), lambda c: F.element_at(F.when(F.size(c) > 0, c), -1)["content"])
    return V.text(F.when(value.isNotNull() & (V.kind(value) != "n"), value).otherwise(last))


def span_tools(attributes: Column) -> Column:
    """Declared tools as JSON texts; null without any."""
    tools = V.items(V.at(attributes, "llm.tools"))
    return F.when(F.size(tools) > 0, F.transform(tools, lambda t: V.text(V.maybe_json(t))))


def span_tool_call(event: Column) -> Column:
    """struct(id, name, arguments) of the invoked tool; null if there is none or tool_calls are there already."""
    attributes = V.at(event, "attributes")
    name = V.first_true(V.at(attributes, "tool.name"), V.at(attributes, "tool_call.function.name"))
    raw = V.first_true(V.at(attributes, "tool.parameters"), V.at(attributes, "tool_call.function.arguments"), V.at(attributes, "input.value"))
    call = F.struct(F.coalesce(V.text(V.at(event, "trace_id")), F.lit("")).alias("id"), V.text(name).alias("name"), F.coalesce(V.text(V.maybe_json(raw)), F.lit("{}")).alias("arguments"))
    return F.when(name.isNotNull() & ~V.truthy(V.at(event, "tool_calls")), call)


def content_text(content: Column) -> Column:
    """A string; the texts of a list's parts joined by a space; anything else as text."""
    part = lambda p: F.coalesce(V.string(p), V.string(V.first_true(V.at(p, "text"), V.at(p, "content"), V.at(p, "input_text"))))
    joined = lambda c: F.array_join(F.filter(F.transform(V.items(c), part), lambda t: t.isNotNull()), " ")
    return V.let(content, lambda c: F.coalesce(V.string(c), joined(c), F.when(V.truthy(c), V.text(c)), F.lit("")))


def prompt_of(messages: Column) -> Column:
    """Texts of the messages with content that users control, one a line."""
    kept = F.filter(messages, lambda m: V.truthy(m["content"]) & ~F.coalesce(m["role"].isin(*UNSCANNED_ROLES), F.lit(False)))
    return F.array_join(F.transform(kept, lambda m: content_text(m["content"])), "\n")


def response_of(event: Column) -> Column:
    """response or output as text: a list's truthy items one a line, an object's content or the object itself."""

    def read(raw):
        lines = F.array_join(F.transform(F.filter(V.items(raw), V.truthy), V.text), "\n")
        content = F.when((V.kind(raw) == "{") & V.truthy(V.at(raw, "content")), V.text(V.at(raw, "content")))
        return F.coalesce(V.string(raw), lines, content, V.text(raw), F.lit(""))

    return V.let(V.first_true(V.at(event, "response"), V.at(event, "output")), read)


def prompt_and_response(event: Column) -> tuple[Column, Column]:
    """Of native events and foreign spans."""
    attributes = V.at(event, "attributes")
    foreign = is_openinference(event)
    filled = V.let(F.when(foreign, span_messages(attributes)), lambda f: F.when(F.size(f) > 0, prompt_of(f)))
    prompt = F.coalesce(filled, prompt_of(native_messages(event)))
    answer = F.when(foreign, F.coalesce(span_response(attributes), response_of(event))).otherwise(response_of(event))
    return prompt, answer


def output_text(value: Column) -> Column:
    """Tool outputs and inputs: null is empty, a string itself, anything else JSON."""
    return F.coalesce(V.text(value), F.lit(""))


def image_of(part: Column) -> Column:
    """struct(url, data, mime) of a content part that is an image with a place or with data; null otherwise.

    A media reference decides alone; then come image_url, source, and inline data.
    """
    item = lambda url, data, mime: F.struct(url.cast("string").alias("url"), data.cast("string").alias("data"), mime.cast("string").alias("mime"))
    none, text = F.lit(None), lambda value, *names: V.text(V.first_true(*(V.at(value, n) for n in names)))

    def media(ref):
        shown = V.string(V.at(ref, "kind")) == "image"
        held = F.when(shown & V.truthy(V.at(ref, "data")), item(none, V.text(V.at(ref, "data")), V.text(V.at(ref, "mime"))))
        return held.when(shown & (V.string(V.at(ref, "source")) == "url") & V.truthy(V.at(ref, "url")), item(V.text(V.at(ref, "url")), none, V.text(V.at(ref, "mime"))))

    def linked(link):
        url = F.when(V.truthy(V.at(link, "url")), V.text(V.at(link, "url"))).when(V.truthy(link), V.string(link))
        return V.let(url, lambda u: F.when(u.isNotNull(), item(u, none, none)))

    def sourced(source):
        given = V.kind(source) == "{"
        out = F.when(given & V.truthy(V.at(source, "url")), item(V.text(V.at(source, "url")), none, V.text(V.at(source, "media_type"))))
        return out.when(given & V.truthy(V.at(source, "data")), item(none, V.text(V.at(source, "data")), V.text(V.at(source, "media_type"))))

    def inlined(inline):
        return F.when((V.kind(inline) == "{") & V.truthy(V.at(inline, "data")), item(none, V.text(V.at(inline, "data")), text(inline, "mime_type", "mimeType")))

    other = F.coalesce(V.let(V.at(part, "image_url"), linked), V.let(V.at(part, "source"), sourced), V.let(V.first_true(V.at(part, "inline_data"), V.at(part, "inlineData")), inlined))
    return V.let(V.at(part, "_media_ref"), lambda ref: F.when(V.kind(ref) == "{", media(ref)).otherwise(other))


def images(event: Column) -> Column:
    """The first images of an event's messages."""
    source = V.first_true(V.at(event, "messages"), V.at(event, "contents"), V.at(event, "input"))
    lists = F.transform(V.items(source), lambda m: V.items(F.when(V.kind(m) == "{", V.at(m, "content")).otherwise(m)))
    parts = F.flatten(F.filter(lists, lambda x: x.isNotNull()))
    found = F.filter(F.transform(F.filter(parts, lambda p: V.kind(p) == "{"), image_of), lambda i: i.isNotNull())
    return F.coalesce(F.slice(found, 1, MOST_IMAGES), F.expr("cast(array() as array<struct<url:string,data:string,mime:string>>)"))


def inline_bytes(images_: Column) -> Column:
    """Decoded inline data of images; null where there is none, or it is malformed or too large."""
    decoded = F.transform(images_, lambda i: F.try_to_binary(i["data"], F.lit("base64")))
    return F.transform(decoded, lambda b: F.when(F.octet_length(b) <= MOST_IMAGE_BYTES, b))


def public_urls(images_: Column) -> Column:
    """URLs of images without inline data, as far as their text shows that they may be fetched; null for others."""
    return F.transform(images_, lambda i: F.when(i["data"].isNull() & is_public_url(i["url"]), i["url"]))


def labelled_texts(texts: Column) -> Column:
    """array<struct<label, text>> of the texts read from images; the label counts all images."""
    pairs = F.transform(texts, lambda t, i: F.struct(F.concat(F.lit("image["), i.cast("string"), F.lit("]")).alias("label"), F.trim(t).alias("text")))
    return F.filter(pairs, lambda p: F.coalesce(p["text"] != "", F.lit(False)))
