"""The conversations as transcripts in JSON Lines, with what real ones have: odd lines, mixed blocks, code, tool calls, commits.

Every turn is a line, and an odd line follows it. An assistant's turn thinks (or not), says its text, with fenced code or
a sentence full of names in some, and calls a tool; a user's is a string, a tool's result (strings, some of which look like
JSON, an object, a number, null), or a text with a result that is a list. The text of the lines is parsed by the transcript operators, as with files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstar.operators.links import cut
from loomstar.operators.star import Star
from loomstar.plans.given_tables import GivenStar, read
from loomstar.sources import transcripts

TOOLS = ["Read", "Bash", "Edit", "Grep"]
FENCES = "\n```py\nprint(1)\nx = 2\n```\nand\n```\nplain\n```"
#: What the sentence of names holds; {c} is the conversation and {t} the turn.
NAMES = "\nSee /src/app_{c}.py and https://example.org/{c} where class Foo{c} has def go_{t}( and import os on git main OSError"
#: Results that begin as JSON does, but are strings; and those that aren't strings, with what Python's str() makes of them.
STRINGS = ["[1, 2, 3]", "[]", '["a"]', '[{"x": 1}]']
VALUES = {'{"stdout":"done","z":{t},"ok":true,"a":null,"list":[1,"b"]}': "{'stdout': 'done', 'z': {t}, 'ok': True, 'a': None, 'list': [1, 'b']}", "{t}": "{t}", "null": "None"}
ODD_LIST, ODD_TEXT = '[{"type":"text","text":7},"bare",{"type":"image"},{"type":"text","text":null}]', "7  None"
START, TRUNCATE = 1_709_251_200, 100


def filled(text: str) -> Column:
    """The text with conversation and turn in place of {c} and {t}."""
    parts = text.replace("{c}", "\0conv_id\0").replace("{t}", "\0turn\0").split("\0")
    return F.concat(*[F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def quoted(text: Column) -> Column:
    json = F.to_json(F.array(text))
    return F.substring(json, 2, F.length(json) - 2)


def lines(conversations: DataFrame) -> DataFrame:
    """session_id, project_path, line_no and line: a turn's entry at three times its number, an odd line after it."""
    c, t, sum_ = F.col("conv_id"), F.col("turn"), F.col("conv_id") + F.col("turn")
    session, last = filled("p{c}"), F.concat(c.cast("string"), F.lit("-"), (t - 1).cast("string"))
    commit = F.concat(F.lit("[main "), F.substring(F.md5(filled("{c}-{t}")), 1, 8), filled("] Commit {t}"))
    body = F.concat("text", F.when(sum_ % 3 == 0, FENCES).otherwise(""), F.when(sum_ % 5 == 1, filled(NAMES)).otherwise(F.lit("")))
    tool = F.element_at(F.array(*[F.lit(x) for x in TOOLS]), (sum_ % 4 + 1).cast("int"))
    thought = F.when(sum_ % 2 == 0, F.concat(F.lit('{"type":"thinking","thinking":'), quoted(filled("On turn {t}")), F.lit("},"))).otherwise("")
    said = F.concat(F.lit("["), thought, F.lit('{"type":"text","text":'), quoted(body), F.lit('},{"type":"tool_use","id":'), quoted(filled("t{c}-{t}")), F.lit(',"name":'), quoted(tool), F.lit(',"input":{"file_path":'), quoted(F.concat(F.lit("/src/m"), (c % 11).cast("string"), F.lit(".py"))), F.lit(',"n":'), t.cast("string"), F.lit("}}]"))
    result = F.concat(F.lit('{"type":"tool_result","tool_use_id":'), quoted(F.concat(F.lit("t"), last)), F.lit(',"content":'))
    given = quoted(F.concat(F.lit("ok\n"), commit, F.lit("\nrest")))
    for k, value in reversed(list(enumerate([commit, *map(F.lit, STRINGS)], 1))):
        given = F.when(c % 9 == k, quoted(value)).otherwise(given)
    for k, value in enumerate(VALUES, 1 + len(STRINGS) + 1):
        given = F.when(c % 9 == k, filled(value)).otherwise(given)
    plain = F.concat(F.lit("["), result, given, F.lit(',"is_error":'), (c % 7 == 0).cast("string"), F.lit("}]"))
    texts = F.when(c % 4 == 1, ODD_LIST).otherwise(F.concat(F.lit('[{"type":"text","text":'), quoted(commit), F.lit('},{"type":"text","text":"done"}]')))
    mixed = F.concat(F.lit('[{"type":"text","text":'), quoted(F.col("text")), F.lit('},"bare",'), result, texts, F.lit("}]"))
    content = F.when(F.col("role") == "assistant", said).when((F.col("role") == "user") & (t % 3 == 1), plain).when((F.col("role") == "user") & (t % 3 == 2), mixed).otherwise(quoted(F.col("text")))
    ts = F.date_format(F.timestamp_seconds(F.lit(START) + c * 3607 + t * 61), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = [("type", quoted(F.col("role"))), ("uuid", quoted(filled("{c}-{t}"))), ("parentUuid", F.when(t > 0, quoted(last)).otherwise("null")), ("timestamp", quoted(ts)), ("sessionId", quoted(session)), ("cwd", F.when(t > 0, F.lit('"/work"')).otherwise("null")), ("gitBranch", quoted(F.concat(F.lit("b"), (t % 2).cast("string")))), ("version", quoted(filled("1.{t}"))), ("isSidechain", (c % 6 == 0).cast("string")), ("isMeta", ((t == 0) & (c % 5 == 0)).cast("string")), ("isCompactSummary", ((F.col("role") == "user") & (t > 0) & (sum_ % 4 == 0)).cast("string")), ("slug", quoted(F.concat(F.lit("s"), (c % 13).cast("string"))))]
    entry = F.concat(F.lit("{"), *[x for k, v in fields for x in (F.lit(f'"{k}":'), v, F.lit(","))], F.lit('"message":{"role":'), quoted(F.col("role")), F.when(F.col("role") == "assistant", F.lit(',"model":"m-opus-9"')).otherwise(""), F.lit(',"content":'), content, F.lit("}}"))
    summary = F.when(t == 0, filled('{"type":"summary","summary":"About {c}"}')).otherwise('{"type":"file-history-snapshot"}')
    odd = F.when(sum_ % 4 == 0, "   ").when(sum_ % 4 == 1, "{broken").when(sum_ % 4 == 2, "[1, 2]").otherwise(summary)
    both = F.posexplode(F.array(entry, odd)).alias("i", "line")
    return conversations.select(session.alias("session_id"), F.concat(F.lit("/w/q"), (c % 3).cast("string")).alias("project_path"), t.alias("turn"), both).select("session_id", "project_path", (F.col("turn") * 3 + F.col("i")).cast("int").alias("line_no"), "line")


#: A tool call's input in an export, and what Python writes for it.
ODD_INPUT = '{"n":{t},"a":{"b":[2,3]},"t":true,"s":"x}y\\"{[","f":null}'
ODD_INPUT_TEXT = '{"n": {t}, "a": {"b": [2, 3]}, "t": true, "s": "x}y\\"{[", "f": null}'


def exported(conversations: DataFrame) -> DataFrame:
    """conv_id and JSON text of each conversation as an account's export has it.

    Every other conversation's tool calls have no id; the call of turn 1 has the same id everywhere, and a result for it
    stands in each first turn of a user, so that it is taken by the conversation before.
    """
    c, t = F.col("conv_id"), F.col("turn")
    ts = F.date_format(F.timestamp_seconds(F.lit(START) + c * 3607 + t * 61), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    own = lambda turn: F.when(turn == 1, "shared").when(c % 2 == 0, F.concat(F.lit("tool_"), filled("p{c}"), F.lit("_"), c.cast("string"), F.lit("-"), turn.cast("string"))).otherwise(F.concat(F.lit("k"), c.cast("string"), F.lit("-"), turn.cast("string")))
    id_ = F.when((t != 1) & (c % 2 == 0), "").otherwise(F.concat(F.lit('"id":'), quoted(own(t)), F.lit(",")))
    thought = F.when((c + t) % 2 == 0, F.concat(F.lit('{"type":"thinking","thinking":'), quoted(filled("In {c} on {t}")), F.lit(',"summaries":[{"summary":"s"}]},'))).otherwise("")
    use = F.concat(F.lit('{"type":"tool_use",'), id_, F.lit('"name":"Edit","input":'), filled(ODD_INPUT), F.lit("}"))
    said = F.concat(thought, F.lit('{"type":"text","citations":[],"text":'), quoted(F.col("text")), F.lit("},"), use)
    answer = F.when(t % 4 == 0, '["odd",{"a":1}]').otherwise(quoted(filled("out } {c}")))
    result = F.concat(F.lit('{"type":"tool_result","tool_use_id":'), quoted(F.when(t == 0, "shared").otherwise(own(t - 1))), F.lit(',"content":'), answer, F.lit("}"))
    asked = F.concat(F.lit('{"type":"text","text":'), quoted(F.col("text")), F.lit("},"), result)
    message = F.concat(F.lit('{"uuid":'), quoted(filled("{c}-{t}")), F.lit(',"text":"","content":['), F.when(F.col("role") == "user", asked).otherwise(said), F.lit('],"sender":'), F.when(F.col("role") == "user", F.lit('"human"')).otherwise(F.lit('"assistant"')), F.lit(',"created_at":'), quoted(ts), F.lit(',"files":[]}'))
    rows = conversations.where("role in ('user', 'assistant')").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"]).alias("_m"))
    head = F.concat(F.lit('{"uuid":'), quoted(filled("p{c}")), F.lit(',"name":"Talk {'), c.cast("string"), F.lit('","account":{"uuid":"}"},"updated_at":'), quoted(F.date_format(F.timestamp_seconds(F.lit(START) + (c * 7919) % 1000 * 86400), "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit(',"chat_messages":['))
    return rows.select("conv_id", F.concat(head, F.array_join("_m", ","), F.lit("]}")).alias("element"))


def files(conversations: DataFrame) -> DataFrame:
    """The transcripts as they would be listed: session_id, project, path, modified, size."""
    c = F.col("conv_id")
    rows = conversations.groupBy("conv_id").agg(F.sum(F.length("text")).alias("size"))
    return rows.select(filled("p{c}").alias("session_id"), F.concat(F.lit("q"), (c % 3).cast("string")).alias("project"), filled("/w/p{c}.jsonl").alias("path"), F.timestamp_seconds(F.lit(START) + c).alias("modified"), "size")


class PlantedStar(GivenStar):
    """The star over these transcripts, with short texts and without thinking."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.sf_dir, self.kept = sf_dir, {}
        self.lines = cut(lines(read(spark, sf_dir, "conversations")), "lines")
        self.all_entries = cut(transcripts.parse_lines(self.lines), "all_entries")
        Star.__init__(self, self.all_entries, TRUNCATE, thinking=False, keep=True)


_stars: dict[tuple[str, str], PlantedStar] = {}


def star(spark: SparkSession, sf_dir: str) -> PlantedStar:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stars:
        _stars[key] = PlantedStar(spark, sf_dir)
    return _stars[key]
