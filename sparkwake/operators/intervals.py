"""Facts that depend on how source code nests: calls and their arguments, annotations, base types, look-ups of variables,
keys of literals. Tokens are rows, brackets are nested intervals, and every step is a window over the tokens of a file.

A text's tokens are cut in the JVM. Running sums over a file give lines and bracket levels; the bracket that encloses a
token is the last one of the level above that has opened, which is a window over (file, level); the same step again gives
the bracket around that one. Files are dealt out once, by path, before their tokens are made; all windows and groups are
by file and more, so tokens never leave their task.

A file whose brackets do not balance gives what its levels allow. Comments and strings are tokens, so brackets in them do
not count. Escaped quotes are put aside before the cut and back after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Languages by extension that are read this way.
BRACED = {"js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "go": "go", "java": "java", "kt": "kotlin", "cs": "csharp", "php": "php"}
LANGUAGES = BRACED | {"py": "python"}
#: Escapes that would end a string, and what stands for them while tokens are cut.
ASIDE = (("\\\\", ""), ('\\"', ""), ("\\'", ""), ("\\`", ""))
NAME = r"[A-Za-z_$][\w$]*+(?:\s*+(?:\?\.|\.|::|->)\s*+[A-Za-z_$][\w$]*+){0,40}"
STRINGS = r"[rRbBfFuU@$]{0,2}(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"[^\"\n]*+\"|'[^'\n]*+'|`[^`]*+`)"
REST = rf"@[A-Za-z_][\w.]*+|{NAME}(?:<[\w\s,.?\[\]<>]{{1,200}}>(?=\s*\())?|\d[\w.]*+|\s++|\|\||\?\?|\?:|=>|:=|==|!=|[^\w\s]"
TOKENS = {"braced": rf"//[^\n]*+|/\*[\s\S]*?\*/|{STRINGS}|{REST}", "python": rf"#[^\n]*+|{STRINGS}|{REST}"}
#: Words before a bracket that do not call; words after which a name is declared.
NO_CALL = ("if", "for", "while", "switch", "catch", "return", "function", "func", "elif", "and", "or", "not", "in", "with", "except", "when", "match", "assert", "synchronized", "using", "lock", "await", "yield", "async", "else", "case")
DECLARE = ("def", "class", "func", "function", "interface", "record", "enum")
#: What stands before the last name of a Go signature, condition or loop: the brace after that begins a block.
NO_LITERAL = (")", "range", "==", "<", ">", "!=", "||", "!", "if", "for", "switch", "select", "else")
#: What stands before a list that is no call.
LISTS = ("List.of", "Set.of", "Arrays.asList", "listOf", "setOf", "string")
#: Brackets around a token that are looked at; all but the call's own must be literals.
AROUND = ("up", "up2", "up3", "up4")
#: Words that name nothing.
NO_NAME = ("new", "true", "false", "True", "False", "null", "None", "nil", "this", "self", "await", "async", "function", "func", "const", "let", "var", "return", "lambda", "public", "static", "final", "class")
FILE = ("repo_id", "path")


def _text(text: Column, back: bool) -> Column:
    for escape, mark in ASIDE:
        text = F.replace(text, F.lit(mark if back else escape), F.lit(escape if back else mark))
    return text


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(*[F.when(ext == e, F.lit(n)) for e, n in LANGUAGES.items()])


def _value(token: Column) -> Column:
    """A string's content: prefix and quotes go."""
    plain = F.regexp_replace(token, r"^[rRbBfFuU@$]{0,2}(?=[\"'`])", "")
    return F.regexp_replace(plain, r"(?s)^(?:\"\"\"(.*)\"\"\"|'''(.*)'''|\"(.*)\"|'(.*)'|`(.*)`)$", "$1$2$3$4$5")


def tokens(files: DataFrame) -> DataFrame:
    """files (repo_id, service, path, text) of LANGUAGES -> a row for each token but white space and comments: pos, line, kind
    (string, name, note, open, close, mark), text, level (open brackets around it), before, before2, after, after2."""
    known = files.select(*FILE, "service", language(F.col("path")).alias("language"), "text").where(F.col("language").isNotNull() & F.col("text").isNotNull())
    cut = {k: F.regexp_extract_all(_text(F.col("text"), False), F.lit(p), F.lit(0)) for k, p in TOKENS.items()}
    every = F.when(F.col("language") == "python", cut["python"]).otherwise(cut["braced"])
    rows = known.repartition(*FILE).select(*FILE, "service", "language", F.posexplode(every).alias("pos", "raw"))
    file = Window.partitionBy(*FILE).orderBy("pos")
    so_far = file.rowsBetween(Window.unboundedPreceding, -1)
    lines = F.length("raw") - F.length(F.replace("raw", F.lit("\n"), F.lit("")))
    first = F.substring("raw", 1, 1)
    string = F.col("raw").rlike(r"^[rRbBfFuU@$]{0,2}[\"'`]")
    comment = F.when(F.col("language") == "python", first == "#").otherwise(F.substring("raw", 1, 2).isin("//", "/*"))
    kind = F.when(comment | F.trim(F.regexp_replace("raw", r"\s", "")).eqNullSafe(""), "none").when(string, "string").when(F.col("raw").rlike(r"^@[A-Za-z_]"), "note")
    kind = kind.when(first.isin("(", "[", "{"), "open").when(first.isin(")", "]", "}"), "close").when(F.col("raw").rlike(r"^[A-Za-z_$]"), "name").otherwise("mark")
    placed = rows.withColumn("line", 1 + F.coalesce(F.sum(lines).over(so_far), F.lit(0))).withColumn("kind", kind).where(F.col("kind") != "none")
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    around = F.coalesce(F.sum(step).over(so_far), F.lit(0)) - F.when(F.col("kind") == "close", 1).otherwise(0)
    text = F.when(F.col("kind").isin("name", "note"), F.regexp_replace("raw", r"\s", "")).otherwise(_text(F.col("raw"), True))
    own = placed.withColumn("level", around.cast("int")).withColumn("text", text).drop("raw")
    near = {"before": F.lag, "before2": lambda c: F.lag(c, 2), "after": F.lead, "after2": lambda c: F.lead(c, 2)}
    return own.withColumns({n: f(F.struct("kind", "text")).over(file) for n, f in near.items()})


#: A bracket: where it opens, which it is, the name before it, the word before that, a key before it, and what follows its end.
BRACKET = ("pos", "text", "head", "before2", "key", "end")


def enclosed(rows: DataFrame) -> DataFrame:
    """tokens with the bracket that encloses each (up: a struct of BRACKET, null at the top) and its place among the parts that
    commas make of what the bracket holds (arg)."""
    closes = F.when(F.col("kind") == "close", F.struct(F.col("pos"), F.col("after.text").alias("after"), F.when(F.col("after2.kind") == "string", F.col("after2.text")).alias("after2")))
    rows = rows.withColumn("closes", closes)
    # of brackets of one level, the one after an opening one closes it
    ends = F.expr("lead(closes) IGNORE NULLS OVER (PARTITION BY repo_id, path, level ORDER BY pos)")
    head = F.when(F.col("before.kind").isin("name", "note"), F.col("before.text"))
    key = F.when(F.col("before.text").isin(":", "=>", "="), F.col("before2.text"))
    marked = rows.withColumn("end", ends).withColumn("bracket", F.when(F.col("kind") == "open", F.struct("pos", "text", head.alias("head"), F.col("before2.text").alias("before2"), key.alias("key"), F.col("end")))).drop("closes", "end")
    # an opening bracket stands in the level around it, and begins the level within
    both = F.when(F.col("kind") == "open", F.array(F.struct(F.lit(1).alias("own"), F.col("level").alias("at")), F.struct(F.lit(0).alias("own"), (F.col("level") + 1).alias("at")))).otherwise(F.array(F.struct(F.lit(1).alias("own"), F.col("level").alias("at"))))
    spread = marked.select("*", F.inline(both))
    inside = Window.partitionBy(*FILE, "at").orderBy("pos", "own")
    commas = F.sum(F.when((F.col("own") == 1) & (F.col("text") == ","), 1).otherwise(0)).over(inside)
    counted = spread.withColumn("commas", commas)
    last = F.last(F.when(F.col("own") == 0, F.struct("bracket", "commas")), ignorenulls=True).over(inside)
    found = counted.withColumn("last", last).where(F.col("own") == 1)
    return found.withColumn("up", F.col("last.bracket")).withColumn("arg", (F.col("commas") - F.col("last.commas")).cast("int")).drop("own", "at", "commas", "last")


def around(rows: DataFrame, up: str, name: str) -> DataFrame:
    """The bracket around the bracket `up` of each token, as `name`."""
    both = F.when(F.col("kind") == "open", F.array(F.struct(F.lit(1).alias("own"), F.col(f"{up}.pos").alias("at")), F.struct(F.lit(0).alias("own"), F.col("pos").alias("at")))).otherwise(F.array(F.struct(F.lit(1).alias("own"), F.col(f"{up}.pos").alias("at"))))
    inside = Window.partitionBy(*FILE, "at").orderBy("own", "pos")
    owner = F.first(F.when(F.col("own") == 0, F.struct(F.col("up").alias("b"))), ignorenulls=True).over(inside)
    found = rows.select("*", F.inline(both)).withColumn("owner", owner).where(F.col("own") == 1)
    return found.withColumn(name, F.when(F.col("at").isNotNull(), F.col("owner.b"))).drop("own", "at", "owner")


def nested(files: DataFrame) -> DataFrame:
    """Tokens with the brackets of AROUND."""
    rows = enclosed(tokens(files))
    for inner, outer in zip(AROUND, AROUND[1:], strict=False):
        rows = around(rows, inner, outer)
    return rows


def _is_call(b: str, language_: Column) -> Column:
    """Whether a bracket holds the arguments of a call: a name stands before it, and nothing is declared."""
    name, before = F.col(f"{b}.head"), F.coalesce(F.col(f"{b}.before2"), F.lit(""))
    round_ = (F.col(f"{b}.text") == "(") & ~before.isin(*DECLARE) & ((before == "new") | ~F.coalesce(F.col(f"{b}.end.after"), F.lit("")).isin("{", "throws") | language_.isin("go", "python"))
    literal = (F.col(f"{b}.text") == "{") & (language_ == "go") & ~before.isin("struct", "interface", *DECLARE, *NO_LITERAL)
    return name.isNotNull() & ~name.isin(*NO_CALL, *LISTS) & ~F.startswith(name, F.lit("@")) & (round_ | literal)


FACT = "struct<pos:int,line:int,kind:string,name:string,value:string,default:string>"


def _fact(when: Column, kind: Column | str, name: Column | None, value: Column | None = None, default: Column | None = None, pos: Column | None = None, line: Column | None = None) -> Column:
    """A fact of a row, or null."""
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    place = [(F.col(n) if c is None else c).cast("int").alias(n) for n, c in (("pos", pos), ("line", line))]
    return F.when(when, F.struct(*place, (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), text(name).alias("name"), text(value).alias("value"), text(default).alias("default")))


def _facts(rows: DataFrame, each: Column) -> DataFrame:
    """rows with an array of facts, some null -> one row a fact."""
    return rows.select("repo_id", "service", "path", F.inline(F.array_compact(each))).withColumnRenamed("pos", "ordinal")


def arguments(rows: DataFrame) -> DataFrame:
    """nested tokens -> calls with their arguments: open, callee, end, args (pos, line, arg, kind: string, template or other, value)."""
    mine = rows.where(_is_call("up", F.col("language")) & ~((F.col("kind") == "mark") & (F.col("text") == ",")))
    # a keyword and its mark are no part of the value
    key = F.col("after.text").isin("=", ":", "=>") & (F.col("kind") != "close")
    value = mine.where(~(F.col("text").isin("=", ":", "=>") & (F.col("kind") == "mark")) & ~F.coalesce(key, F.lit(False)))
    part = F.when(F.col("kind") == "string", _value(F.col("text"))).when(F.col("kind") == "name", F.concat(F.lit("${"), F.col("text"), F.lit("}"))).otherwise("")
    each = value.groupBy(*FILE, "service", F.col("up.pos").alias("open"), F.col("up.head").alias("callee"), F.col("up.end").alias("end"), "arg").agg(
        F.min("pos").alias("pos"), F.min("line").alias("line"), F.count("*").alias("n"), F.count_if(F.col("kind") == "string").alias("strings"), F.count_if(F.col("text") == "+").alias("plus"),
        F.array_join(F.array_sort(F.collect_list(F.struct("pos", part.alias("part"))))["part"], "").alias("value"),
    )
    kind = F.when((F.col("n") == 1) & (F.col("strings") == 1), F.when(F.col("value").rlike(r"\$\{|#\{"), "template").otherwise("string")).when((F.col("strings") > 0) & (F.col("plus") > 0), "template").otherwise("other")
    one = F.struct("arg", "pos", "line", kind.alias("kind"), F.when(kind != "other", F.col("value")).alias("value"))
    return each.groupBy(*FILE, "service", "open", "callee", "end").agg(F.array_sort(F.collect_list(one)).alias("args"))


#: Calls and look-ups that read the environment.
ENV_CALL = r"^(?:os\.environ\.get|os\.getenv|os\.Getenv|os\.LookupEnv|System\.getenv|getenv|env|Environment\.GetEnvironmentVariable|[Cc]onfig(?:uration)?\.(?:get|Get|GetValue))(?:<.*>)?$"
ENV_INDEX = r"^(?:process\.env|os\.environ|_?[Cc]onfiguration|\$_ENV|\$_SERVER)$"
OTHERWISE = ("||", "??", "or", "?:")


def facts(files: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """files (repo_id, service, path, text) -> facts (repo_id, service, path, ordinal, line, kind, name, value, default):

    call (callee, a literal argument, its place), call_template (the same of a concatenation or template), call_name (callee of
    `methods`, a name among its arguments, or in literals within them), call_key (callee#keys, a literal by the path of keys that
    leads to it), annotation and annotation_name, extends (base type, its type argument), event_type, stub, env."""
    rows = nested(files)
    return _of_calls(rows).unionByName(_of_tokens(rows, methods))


def _of_calls(rows: DataFrame) -> DataFrame:
    """Literal arguments, and look-ups of the environment by a call: a second argument, or a literal beyond an `or`, is the default."""
    given = F.transform("args", lambda a: _fact(a["kind"] != "other", F.when(a["kind"] == "string", "call").otherwise("call_template"), F.col("callee"), a["value"], a["arg"], a["pos"], a["line"]))
    looked = arguments(rows).withColumn("first", F.try_element_at(F.filter("args", lambda a: (a["arg"] == 0) & (a["kind"] == "string")), F.lit(1))).withColumn("second", F.try_element_at(F.filter("args", lambda a: (a["arg"] == 1) & (a["kind"] == "string")), F.lit(1)))
    env = _fact(F.col("callee").rlike(ENV_CALL) & F.col("first").isNotNull(), "env", F.col("first.value"), None, F.coalesce("second.value", _beyond("end")), F.col("first.pos"), F.col("first.line"))
    return _facts(looked, F.concat(given, F.array(env)))


def _beyond(end: str) -> Column:
    return F.when(F.col(f"{end}.after").isin(*OTHERWISE), _value(F.col(f"{end}.after2")))


def _of_tokens(rows: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    language_, text, kind = F.col("language"), F.col("text"), F.col("kind")
    false = lambda c: F.coalesce(c, F.lit(False))
    is_key = false(F.col("after.text").isin(":", "=>", "=") & kind.isin("name", "string"))
    # the call of whose arguments a token is part, through up to two literals
    literal = lambda b: (F.col(f"{b}.text").isin("{", "[") | F.col(f"{b}.head").isin(*LISTS)) & ~_is_call(b, language_)
    callee, keyed, through = F.when(_is_call("up", language_), F.col("up.head")), [], F.lit(True)
    for inner, outer in zip(AROUND, AROUND[1:], strict=False):
        through = through & literal(inner)
        callee = callee.when(through & _is_call(outer, language_), F.col(f"{outer}.head"))
        keyed.insert(0, F.when(through, F.col(f"{inner}.key")))
    method = lambda c: F.lower(F.regexp_extract(F.regexp_replace(c, "<.*", ""), r"(\w+)$", 1))
    own_key = F.when(F.col("before.text").isin(":", "=>", "=") & F.col("before2.kind").isin("name", "string"), F.col("before2.text"))
    keys = F.regexp_replace(F.concat_ws(".", *keyed, own_key), r"[\"'`]", "")
    head = F.when((kind == "open") & _is_call("bracket", language_), F.col("bracket.head"))
    generic = F.nullif(F.regexp_extract("head", r"<\s*(\w+)", 1), F.lit(""))
    note = lambda b: F.when(F.startswith(F.coalesce(F.col(f"{b}.head"), F.lit("")), F.lit("@")) & (F.col(f"{b}.text") == "("), F.substring(F.col(f"{b}.head"), 2, 1000))
    # base types: names after extends or implements up to the body; of Python what the class's brackets hold
    file = Window.partitionBy(*FILE).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    since = F.when(text.isin("extends", "implements", "{", "}", ";", "(", ")", "=", "class", "interface") | ((text == ":") & false(F.col("before2.text").isin("class", "interface", "record"))), text)
    told = rows.withColumns({"callee": callee, "keys": keys, "head": head, "note": F.coalesce(*[note(b) for b in AROUND]), "since": F.last(since, ignorenulls=True).over(file)})
    of_class = (language_ == "python") & (F.col("up.text") == "(") & (F.col("up.before2") == "class")
    plain = (kind == "name") & ~is_key & ~text.isin(*NO_NAME)
    sends = method(F.col("callee")).isin(*methods)
    return _facts(told, F.array(
        _fact(plain & sends & ~false(F.col("after.text") == "("), "call_name", F.col("callee"), text),
        _fact((kind == "string") & ~is_key & F.col("callee").isNotNull() & ((F.col("keys") != "") | literal("up")), "call_key", F.concat_ws("#", "callee", "keys"), _value(text)),
        _fact(method(F.col("head")).isin(*methods) & generic.isNotNull(), "event_type", F.when(F.contains(method(F.col("head")), F.lit("subscri")), "consumer").otherwise("producer"), generic),
        _fact((F.col("bracket.before2") == "new") & F.col("head").rlike("Event$") & ~F.col("head").rlike("DomainEvent$"), "event_type", F.lit("producer"), F.col("head")),
        _fact(F.regexp_replace("head", "<.*", "").rlike(r"(?:Client|Stub|Server|to_server)$"), "stub", F.col("head")),
        _fact((kind == "string") & F.col("note").isNotNull() & ~is_key, "annotation", F.col("note"), _value(text)),
        _fact(plain & F.col("note").isNotNull(), "annotation_name", F.col("note"), text),
        _fact(plain & ~false(F.col("before.text") == "<") & false(F.col("since").isin("extends", "implements", ":") | of_class) & ~text.isin("extends", "implements"), "extends", text, F.when(F.col("after.text") == "<", F.col("after2.text"))),
        _fact((kind == "name") & text.rlike(r"^process\.env\.\w+$"), "env", F.regexp_extract("text", r"(\w+)$", 1), None, F.when(F.col("after.text").isin(*OTHERWISE) & (F.col("after2.kind") == "string"), _value(F.col("after2.text")))),
        _fact((kind == "string") & (F.col("up.text") == "[") & F.col("up.head").rlike(ENV_INDEX), "env", _value(text), None, _beyond("up.end")),
    ))
