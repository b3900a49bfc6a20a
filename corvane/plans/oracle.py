"""The registered queries as SQL over the driver's tables."""

from __future__ import annotations

from corvane.operators.sampling import ROUNDS
from corvane.plans.surrogates import OPS, text_sql
from corvane.vocab import ACTIONS, DOCUMENT_SEPARATOR, PARAPHRASED_TYPES, PER_TRIGGER_APP, PROMPT_LAYOUTS, TEMPLATES, TRIGGERS

SEED = "7"


def _quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _lit(text: str) -> str:
    """String literal; line breaks and tabs as chr()."""
    out = "'" + text.replace("'", "''") + "'"
    return "(" + out.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + ")"


OPS_SQL = "[" + _quoted(OPS) + "]"
KIND = f"CASE WHEN op IN ({_quoted(ACTIONS)}) THEN 'actions' WHEN op IN ({_quoted(TRIGGERS)}) THEN 'triggers' END"
NL = "chr(10)"


def digest(seed: str, *keys: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(f'({k})::VARCHAR' for k in keys)}))"


def u(seed: str, *keys: str) -> str:
    return f"((('0x' || substr({digest(seed, *keys)}, 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def idx(n: str, seed: str, *keys: str) -> str:
    return f"floor({u(seed, *keys)} * ({n}))::BIGINT"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '(\\S+)', 1)"


def n_words(x: str) -> str:
    return f"len({words(x)})"


def rest(x: str) -> str:
    return f"array_to_string(({words(x)})[2:], ' ')"


def cap(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"


def trigger_phrase(x: str) -> str:
    return (
        f"CASE WHEN starts_with({x}, 'Triggers when') THEN {cap(f'''('When ' || rtrim(ltrim(substr({x}, 14)), '.'))''')} "
        f"WHEN suffix({x}, 's') THEN 'For ' || rtrim(lower({x}), '.') ELSE 'For a ' || rtrim(lower({x}), '.') END"
    )


def verb_first(x: str) -> str:
    first = f"lower({words(x)}[1])"
    verb = (
        f"CASE {first} WHEN 'creates' THEN 'create' WHEN 'retrieves' THEN 'retrieve' WHEN 'updates' THEN 'update' "
        f"WHEN 'deletes' THEN 'delete' ELSE {first} END"
    )
    return f"({verb} || CASE WHEN {n_words(x)} > 1 THEN ' ' || {rest(x)} ELSE '' END)"


# --- Common table expressions ------------------------------------------------------------------------


def encoded(name: str, source: str, dim: int) -> list[str]:
    """CTEs of the hashed vectors of a table (id, text): ``name`` has their entries (id, position, value)."""
    return [rf"""
{name}_w AS (SELECT id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') w FROM {source}),
{name}_t AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) t FROM {name}_w),
{name}_n AS (SELECT id, code % {dim} AS position, sum(CASE WHEN code < {dim} THEN 1 ELSE -1 END) n
  FROM (SELECT id, ('0x' || substr(md5(t), 25, 8))::BIGINT % {2 * dim} code FROM {name}_t) GROUP BY ALL),
{name} AS (SELECT id, position, (n / sqrt(sum(n * n) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS value FROM {name}_n WHERE n <> 0)"""]


def catalog(wide: bool = False, many: bool = False) -> str:
    obj = "replace(p_name, ' ', '') || p_size" if wide else "string_split(p_name, ' ')[2]"
    app, shown = ("|| 'x' || p_size", "|| ' ' || p_size") if many else ("", "")
    template = " ".join(f"WHEN '{o}' THEN {_lit(t)}" for o, t in TEMPLATES.items())
    return f"""
trip AS (SELECT DISTINCT replace(lower(p_brand), '#', '') {app} app, {obj} object,
    ({OPS_SQL})[(p_partkey % 13) + 1] op, replace(p_brand, '#', ' ') {shown} app_display_name FROM part),
cmds AS (SELECT app || '.' || object || '.' || op command, app, object, op, {KIND} kind,
    {text_sql(0)} description, app_display_name,
    upper(substr(object, 1, 1)) || substr(object, 2) || 's' object_display_name,
    {text_sql(1)} operation_display_name, CASE op {template} END template FROM trip)"""


PRODUCTS = """
prows AS (SELECT DISTINCT replace(lower(p_brand), '#', '') app, substr(p_brand, 7)::INT n FROM part),
products AS (SELECT app, unnest(list_filter([CASE WHEN n % 2 = 0 THEN 'server' END, CASE WHEN n % 3 = 0 THEN 'cloud' END,
    CASE WHEN n % 2 <> 0 AND n % 3 <> 0 THEN 'demo' END], lambda x: x IS NOT NULL)) product FROM prows
  UNION ALL SELECT lower(s_name), unnest(['server', 'demo']) FROM supplier WHERE s_suppkey <> 0),
plist AS (SELECT app, string_agg(product, ',' ORDER BY CASE product WHEN 'server' THEN 1 WHEN 'cloud' THEN 2 ELSE 3 END) products
  FROM products GROUP BY app)"""


def utt(seed: str | None = f"{SEED}/caps", name: str = "utt") -> str:
    def filled(source: int, app: str, obj: str) -> str:
        names = f"({app} || ' ' || {obj})"
        if seed is not None:
            names = f"CASE WHEN {u(seed, 'command', str(source))} < 0.5 THEN lower{names} ELSE {names} END"
        return f"replace(template, '{{app}} {{object}}', {names})"

    cols = "app, object, op, app_display_name, object_display_name, app app_list"
    return f"""
{name}_all AS (SELECT command, 1 source, description, {cols} FROM cmds
  UNION ALL SELECT command, 2, operation_display_name, {cols} FROM cmds
  UNION ALL SELECT command, 3, {filled(3, 'app', 'object')}, {cols} FROM cmds
  UNION ALL SELECT command, 4, {filled(4, 'app_display_name', 'object_display_name')}, {cols} FROM cmds),
{name} AS (SELECT * FROM {name}_all WHERE {n_words('description')} >= 2)"""


def drawn(name: str, stream: str, seed: str = SEED, source: str = "utt") -> str:
    nw = n_words("description") + "::DOUBLE"
    st = f"'{stream}'"
    return f"""
{name}_s AS (SELECT *, {nw} - ln(-ln({u(seed + '/first', st, 'command', 'source')})) s1,
    ln({nw}) - ln(-ln({u(seed + '/second', st, 'command', 'source')})) s2,
    {u(seed + '/fraction', st, 'command')} < 0.1 wanted FROM {source}),
{name}_f AS (SELECT *, row_number() OVER (PARTITION BY command ORDER BY s1 DESC) r1 FROM {name}_s),
{name}_g AS (SELECT *, row_number() OVER (PARTITION BY command, r1 = 1 ORDER BY s2 DESC) r2 FROM {name}_f),
{name} AS (SELECT * FROM {name}_g WHERE r1 = 1 OR (r2 = 1 AND wanted))"""


def member(name: str, source: str, where: str) -> str:
    return f"""
{name} AS (SELECT *, row_number() OVER (PARTITION BY app ORDER BY {digest('order', 'command', 'source')}, command, source) - 1 i,
    count(*) OVER (PARTITION BY app) n FROM {source} WHERE {where}),
{name}_apps AS (SELECT app, n, row_number() OVER (ORDER BY md5(app), app) - 1 g, count(*) OVER () m FROM (SELECT DISTINCT app, n FROM {name}))"""


IS_TRIGGER = f"op IN ({_quoted(TRIGGERS)})"


def pairs(name: str, left: str, right: str, seed: str) -> str:
    return f"""
{name}_k AS (SELECT a.app app_t, b.app app_a, {idx('a.n', seed + '/left', 'a.app', 'b.app')} i_t,
    {idx('b.n', seed + '/right', 'a.app', 'b.app')} i_a FROM {left}_apps a, {right}_apps b),
{name} AS (SELECT k.app_t, k.app_a, t.command command_t, t.description description_t, t.object object_t,
    t.app_display_name adn_t, t.object_display_name odn_t, a.command command_a, a.description description_a,
    a.app_display_name adn_a, a.object_display_name odn_a
  FROM {name}_k k JOIN {left} t ON t.app = k.app_t AND t.i = k.i_t JOIN {right} a ON a.app = k.app_a AND a.i = k.i_a)"""


def permuted(source: str, seed: str, key: str, n: str) -> str:
    """The rounds of ``sampling.permuted`` over the columns ``x0`` and ``y0`` of a table; the result is in ``x`` and ``y``."""
    x, y, parts = "x0", "y0", []
    for k in range(ROUNDS):
        moved, fixed = (x, y) if k % 2 == 0 else (y, x)
        new = f"{moved[0]}{k + 1}"
        source = f"(SELECT *, ({moved} + {idx(n, f'{seed}/{k}', key, fixed)}) % {n} {new} FROM {source})"
        x, y = (new, y) if k % 2 == 0 else (x, new)
    return f"(SELECT *, {x} x, {y} y FROM {source})"


def triples(number: int) -> str:
    seed = f"{SEED}/{number}"
    return f"""{drawn('dp', f'{number}/pair')}, {drawn('dt', f'{number}/third')},
{member('tt', 'dp', IS_TRIGGER)}, {member('aa', 'dp', f'NOT {IS_TRIGGER}')}, {member('bb', 'dt', f'NOT {IS_TRIGGER}')},
places AS (SELECT t.app app_t, t.n n_t, s.m, pos // s.m x0, pos % s.m y0
  FROM tt_apps t, (SELECT m, unnest(range(least({PER_TRIGGER_APP}, m * m))) pos FROM (SELECT max(m) m FROM aa_apps)) s),
keys AS (SELECT c.app_t, a.app app_a, b.app app_b, {idx('c.n_t', seed + '/left', 'c.app_t', 'a.app')} i_t,
    {idx('a.n', seed + '/right', 'c.app_t', 'a.app')} i_a, {idx('b.n', seed + '/third', 'c.app_t', 'a.app', 'b.app')} i_b
  FROM {permuted('places', seed + '/cap', 'app_t', 'm')} c JOIN aa_apps a ON a.g = c.x JOIN bb_apps b ON b.g = c.y),
tri AS (SELECT k.*, t.command command_t, t.description description_t, a.command command_a, a.description description_a,
    b.command command_b, b.description description_b
  FROM keys k JOIN tt t ON t.app = k.app_t AND t.i = k.i_t JOIN aa a ON a.app = k.app_a AND a.i = k.i_a
  JOIN bb b ON b.app = k.app_b AND b.i = k.i_b)"""


def opening() -> str:
    return f"({trigger_phrase('description_t')}) || ', ' || rtrim({verb_first('description_a')}, '.')"


PLURAL = "lower(rtrim({x}, 's')) || 's'"


def plural(x: str) -> str:
    return f"(lower(rtrim({x}, 's')) || 's')"


OBJECTS = """
objs AS (SELECT app || '.' || object objects, app, object, min(app_display_name) app_display_name,
    min(object_display_name) object_display_name FROM utt GROUP BY app, object)"""


def sample_type(t: int) -> tuple[str, str]:
    """(CTEs after catalog and utt, final select) of one sample type."""
    if t == 1:
        return drawn("d1", "1"), "SELECT description utterances, command commands, app app_list, 1 \"type\" FROM d1"
    if t == 2:
        ctes = f"{drawn('d2', '2')}, {member('t2', 'd2', IS_TRIGGER)}, {member('a2', 'd2', f'NOT {IS_TRIGGER}')}, {pairs('p2', 't2', 'a2', f'{SEED}/2')}"
        return ctes, f"SELECT {opening()} utterances, command_t || {NL} || command_a commands, app_t || ',' || app_a app_list, 2 \"type\" FROM p2"
    if t == 3:
        return triples(3), (
            f"SELECT rtrim({opening()}, '.') || ' and ' || {verb_first('description_b')} utterances, "
            f"command_t || {NL} || command_a || {NL} || command_b commands, app_t || ',' || app_a || ',' || app_b app_list, 3 \"type\" FROM tri"
        )
    if t == 4:
        ut = u(f"{SEED}/4/text", "command_t", "command_a", "command_b")
        tp = f"({trigger_phrase('description_t')})"
        low = {x: f"rtrim(lower(description_{x}), '.')" for x in "ab"}
        verb = {x: f"rtrim({verb_first(f'description_{x}')}, '.')" for x in "ab"}
        text = (
            f"CASE WHEN {ut} < 1.0/3.0 THEN {tp} || ', ' || {verb['a']} || ' if CONDITION, else ' || {verb['b']} "
            f"WHEN {ut} < 2.0/3.0 THEN rtrim({cap('description_a')}, '.') || ' ' || lower({tp}) || ' if CONDITION, else ' || {low['b']} "
            f"ELSE 'If CONDITION, ' || lower({tp}) || ' ' || {low['a']} || ', else ' || {low['b']} END"
        )
        program = f"command_t || {_lit(chr(10) + 'if CONDITION:' + chr(10) + chr(9))} || command_a || {_lit(chr(10) + 'else:' + chr(10) + chr(9))} || command_b"
        return triples(4), f"SELECT {text} utterances, {program} commands, app_t || ',' || app_a || ',' || app_b app_list, 4 \"type\" FROM tri"
    if t == 5:
        ctes = f"""{drawn('d5', '5')}, {member('t5', 'd5', "op = 'RETRIEVEALL'")}, {member('a5', 'd5', "op = 'CREATE'")}, {pairs('p5', 't5', 'a5', f'{SEED}/5')}"""
        return ctes, (
            f"SELECT 'For each ' || app_t || ' ' || lower(object_t) || ', ' || rtrim({verb_first('description_a')}, '.') utterances, "
            f"'for ' || lower(object_t) || ' in ' || command_t || {_lit(':' + chr(10) + chr(9))} || command_a commands, app_t || ',' || app_a app_list, 5 \"type\" FROM p5"
        )
    if t == 6:
        ctes = f"""{OBJECTS}, o6 AS (SELECT objects command, 0 source, NULL description, * FROM objs),
{member('m6', 'o6', 'true')}, {pairs('p6', 'm6', 'm6', f'{SEED}/6')}"""
        return ctes, (
            f"SELECT 'Sync new ' || adn_t || ' ' || {plural('odn_t')} || ' with ' || adn_a || ' ' || {plural('odn_a')} utterances, "
            f"command_t || '.CREATED' || {NL} || command_t || '.RETRIEVEALL' || {NL} || command_a || '.CREATE' commands, "
            f"app_t || ',' || app_a app_list, 6 \"type\" FROM p6"
        )
    verb, tail = ("Move", f" || {NL} || a.objects || '.DELETEALL'") if t == 7 else ("Copy", "")
    return OBJECTS, (
        f"SELECT '{verb} ' || {plural('a.object_display_name')} || ' from ' || a.app_display_name || ' to ' || b.app_display_name utterances, "
        f"'for ' || lower(a.object) || ' in ' || a.objects || {_lit('.RETRIEVEALL:' + chr(10) + chr(9))} || b.objects || '.CREATE'{tail} commands, "
        f"a.app || ',' || b.app app_list, {t} \"type\" FROM objs a JOIN objs b ON lower(a.object) = lower(b.object) AND a.app <> b.app"
    )


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join(ctes) + " "


def _sample(t: int, wide: bool = False, many: bool = False) -> str:
    ctes, final = sample_type(t)
    return _with(catalog(wide, many), utt(), ctes) + final


def _corpus() -> str:
    parts = []
    for t in range(1, 9):
        ctes, final = sample_type(t)
        parts.append(f"(SELECT * FROM ({_with(ctes)} {final}))")
    return _with(catalog(), utt()) + " UNION ALL ".join(parts)


# --- Elements and graph ---------------------------------------------------------------------------------

SILVER = """
a AS (SELECT DISTINCT app, app_display_name display_name FROM cmds),
o AS (SELECT DISTINCT app, object, object_display_name display_name FROM cmds),
op AS (SELECT app, object, op, kind, operation_display_name display_name, description FROM cmds)"""

ELEMENTS = """
kinds AS (SELECT app, object, string_agg(DISTINCT kind, ',' ORDER BY kind) op_types FROM cmds GROUP BY app, object),
el AS (SELECT 'app' typename, app full_name, NULL parent_name, NULL op_types, app FROM a
  UNION ALL SELECT 'bo', app || '/' || object, app, op_types, app FROM kinds
  UNION ALL SELECT 'op', app || '/' || object || '/' || op, app || '/' || object, kind, app FROM op),
eln AS (SELECT el.*, products, row_number() OVER (ORDER BY md5(full_name), full_name) - 1 element_id FROM el LEFT JOIN plist USING (app)),
elements AS (SELECT e.element_id, e.typename, e.full_name, p.element_id parent_id, e.op_types, e.products
  FROM eln e LEFT JOIN eln p ON p.full_name = e.parent_name)"""

# --- JSON surrogate: what the documents say, without JSON -------------------------------------------------

JSON = """
jn AS (SELECT *, substr(app, 6)::INT % 2 = 0 nested, object = 'gizmo' AND starts_with(app, 'brand2') broken FROM cmds),
jl AS (SELECT * FROM jn WHERE NOT broken),
japp AS (SELECT DISTINCT app, nested, app_display_name display_name,
    CASE WHEN length(app) = 7 THEN 'About ' || app_display_name END description FROM jl),
jschema AS (SELECT DISTINCT app, object FROM jn WHERE NOT nested AND object NOT IN ('rod', 'plate') AND op <> 'DELETED'),
jobj AS (SELECT DISTINCT l.app, l.object, l.nested, l.object_display_name shown, s.object IS NOT NULL has_schema,
    CASE WHEN l.nested AND l.object = 'rod' THEN NULL ELSE l.object_display_name END own_display,
    l.object_display_name || CASE WHEN l.object = 'gear' THEN '!' ELSE '' END inner_display,
    CASE WHEN l.nested AND l.object = 'bolt' THEN NULL ELSE 'All about ' || l.object_display_name END description
  FROM jl l LEFT JOIN jschema s USING (app, object)),
jop AS (SELECT l.* FROM jl l LEFT JOIN jschema s USING (app, object) WHERE s.object IS NULL OR l.op <> 'DELETED')"""

JPROPS = """
jp AS (SELECT app, object, op, kind FROM jop JOIN jschema USING (app, object)),
jdir AS (SELECT app, object, op, 'request' direction, kind = 'actions' included FROM jp
  UNION ALL SELECT app, object, op, 'response', false FROM jp)"""

# --- Vectors ------------------------------------------------------------------------------------------------

TREE = """
tree AS (SELECT vec_id, embedding::DOUBLE[] v, label, CASE WHEN vec_id < 25 THEN 'app' WHEN vec_id < 225 THEN 'bo' ELSE 'op' END typename,
    CASE WHEN vec_id < 25 THEN NULL WHEN vec_id < 225 THEN vec_id % 25 ELSE 25 + vec_id % 200 END parent_id,
    CASE WHEN vec_id < 25 THEN NULL WHEN vec_id < 225 THEN ['actions', 'triggers'] WHEN label < 6 THEN ['actions'] ELSE ['triggers'] END op_types,
    CASE WHEN label = 0 THEN ['server'] ELSE ['server', 'cloud'] END products FROM embeddings),
req AS (SELECT vec_id request_id, embedding::DOUBLE[] v, CASE label WHEN 1 THEN 'actions' WHEN 4 THEN 'triggers' WHEN 7 THEN 'actions' END kind FROM embeddings)"""


def dist(a: str, b: str) -> str:
    return f"round(list_cosine_distance({a}, {b}), 9)"


def match(where: str) -> str:
    return _with(TREE, f"""
cand AS (SELECT * FROM tree WHERE {where}),
h1 AS (SELECT request_id, vec_id app_id, 0.8::DOUBLE * greatest(d, 0) score FROM (SELECT request_id, c.vec_id, {dist('r.v', 'c.v')} d,
    row_number() OVER (PARTITION BY request_id ORDER BY {dist('r.v', 'c.v')}, c.vec_id) k FROM req r, cand c WHERE typename = 'app') WHERE k <= 5),
h2 AS (SELECT request_id, app_id, vec_id object_id, score + 0.6::DOUBLE * greatest(d, 0) score FROM (SELECT r.request_id, h1.app_id, c.vec_id, h1.score, {dist('r.v', 'c.v')} d,
    row_number() OVER (PARTITION BY r.request_id ORDER BY {dist('r.v', 'c.v')}, c.vec_id) k
  FROM req r JOIN h1 USING (request_id) JOIN cand c ON c.parent_id = h1.app_id AND c.typename = 'bo' AND (r.kind IS NULL OR list_contains(c.op_types, r.kind))) WHERE k <= 25),
h3 AS (SELECT request_id, app_id, object_id, vec_id op_id, score + 0.4::DOUBLE * greatest(d, 0) score FROM (SELECT r.request_id, h2.app_id, h2.object_id, c.vec_id, h2.score, {dist('r.v', 'c.v')} d,
    row_number() OVER (PARTITION BY r.request_id ORDER BY {dist('r.v', 'c.v')}, c.vec_id) k
  FROM req r JOIN h2 USING (request_id) JOIN cand c ON c.parent_id = h2.object_id AND c.typename = 'op' AND (r.kind IS NULL OR list_contains(c.op_types, r.kind))) WHERE k <= 100)""") + """
SELECT request_id, rank, app_id, object_id, op_id, 'app' || app_id app, 'app' || object_id % 25 || '/bo' || object_id object,
  'app' || (25 + op_id % 200) % 25 || '/bo' || (25 + op_id % 200) || '/op' || op_id op, tree.op_types[1] kind, round(score, 6) score
FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score, op_id) rank FROM h3) JOIN tree ON tree.vec_id = op_id WHERE rank <= 5"""


def knn(where_item: str = "true", k: int = 5) -> str:
    return _with(TREE) + f"""SELECT query_id, item_id, round(d, 6) distance, rank FROM (SELECT q.vec_id query_id, c.vec_id item_id, {dist('q.v', 'c.v')} d,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {dist('q.v', 'c.v')}, c.vec_id) rank FROM tree q, tree c WHERE {where_item}) WHERE rank <= {k}"""


# --- Conversations -----------------------------------------------------------------------------------------

TEST = """
test AS (SELECT a.conv_id, a.turn, a.text utterances, b.text commands, a.conv_id % 8 + 1 "type",
    CASE WHEN a.turn = 0 THEN 'first' ELSE 'later' END subtype,
    CASE a.conv_id % 3 WHEN 0 THEN b.text || ' x' WHEN 1 THEN '[' || b.text || ']' ELSE 'Answer: ' || b.text END generations
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"""


def loop_var(x: str) -> str:
    return f"regexp_replace({x}, 'for (\\w+) in', 'for x in', 'g')"


SCORED = f"""
prog AS (SELECT *, replace({loop_var("translate(generations, chr(92) || '[]', '')")}, chr(9), ' ') p, replace({loop_var('commands')}, chr(9), ' ') label FROM test),
flat AS (SELECT *, replace(p, chr(10), ' ') f FROM prog),
resp AS (SELECT *, replace({loop_var('''CASE WHEN instr(f, ':') = 0 OR contains(lower(split_part(f, ':', 1)), 'if ') OR contains(lower(split_part(f, ':', 1)), 'for ')
    THEN p ELSE trim(substr(f, instr(f, ':') + 1)) END''')}, chr(9), ' ') response FROM flat),
scored AS (SELECT *, regexp_extract_all(response, '(\\w+|[^\\w ])', 1) = regexp_extract_all(label, '(\\w+|[^\\w ])', 1) exact FROM resp)"""

LINES = """
opening AS (SELECT conv_id, min(turn) t0 FROM conversations WHERE role = 'user' GROUP BY conv_id),
lines AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN '#' || replace(text, chr(10), ' ') WHEN role = 'assistant' THEN ' ' || replace(text, chr(10), ' ')
    WHEN turn = t0 THEN replace(text, chr(10), ' ') ELSE '@' || replace(text, chr(10), ' ') END line FROM conversations LEFT JOIN opening USING (conv_id))"""


def records(variations: bool) -> str:
    marks = "(' ', '@')" if variations else "(' ')"
    return f"""{LINES},
kept AS (SELECT *, substr(line, 1, 1) mark FROM lines WHERE line <> '' AND substr(line, 1, 1) <> '#'),
numd AS (SELECT *, sum(CASE WHEN mark NOT IN {marks} THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT record FROM kept),
parts AS (SELECT conv_id, record, turn, {"mark = '@'" if variations else 'false'} alt, CASE WHEN mark IN {marks} THEN substr(line, 2) ELSE line END || {NL} txt FROM numd WHERE record > 0),
firsts AS (SELECT conv_id, record, min(turn) FILTER (WHERE alt) fa FROM parts GROUP BY ALL),
heads AS (SELECT conv_id, record, string_agg(txt, '' ORDER BY turn) FILTER (WHERE fa IS NULL OR turn < fa) head,
    coalesce(string_agg(txt, '' ORDER BY turn) FILTER (WHERE turn > fa AND NOT alt), '') tail FROM parts JOIN firsts USING (conv_id, record) GROUP BY ALL),
variants AS (SELECT conv_id, record, head, tail FROM heads UNION SELECT conv_id, record, txt, tail FROM parts JOIN heads USING (conv_id, record) WHERE alt),
samples AS (SELECT conv_id, record, regexp_replace(head || tail, '^\\s+|\\s+$', '', 'g') sample FROM variants),
pairs AS (SELECT conv_id, record, split_part(sample, {NL}, 1) utterances,
    replace(replace(regexp_replace(CASE WHEN instr(sample, {NL}) > 0 THEN substr(sample, instr(sample, {NL}) + 1) ELSE '' END, '^\\s+', ''),
      {NL} || '  ', {NL} || chr(9)), '()', '') commands FROM samples)"""


ALIASES = """
aliases AS (SELECT DISTINCT replace(p_brand, '#', ' ') app_display_name, unnest(['b' || substr(p_brand, 7), 'brand-' || substr(p_brand, 7)]) alias
  FROM part WHERE substr(p_brand, 7)::INT % 4 = 0)"""
TEMPLATED = """
templated AS (SELECT command, app, object, app_display_name, object_display_name, arg_max(description, source) templated FROM utt GROUP BY ALL)"""

UNIQUE = """
groups AS (SELECT DISTINCT app_display_name, object_display_name FROM cmds),
uniq AS (SELECT min(app_display_name) app_display_name, min(object_display_name) object_display_name FROM groups
  GROUP BY rtrim(lower(object_display_name), 's') HAVING count(*) = 1)"""

UNIQUE_EVAL = f"""{UNIQUE},
per_app AS (SELECT * FROM uniq QUALIFY row_number() OVER (PARTITION BY app_display_name ORDER BY {digest(SEED + '/object', 'app_display_name', 'object_display_name')}) = 1),
chosen AS (SELECT * FROM per_app ORDER BY {digest(SEED + '/n', 'app_display_name', 'object_display_name')} LIMIT 25),
picked AS (SELECT c.* FROM cmds c JOIN chosen USING (app_display_name, object_display_name)
  QUALIFY row_number() OVER (PARTITION BY app_display_name, object_display_name ORDER BY {digest(SEED + '/command', 'command')}) = 1)"""

ALIAS_EVAL = f"""{ALIASES}, {TEMPLATED},
al AS (SELECT command, replace(templated, t.app_display_name, alias) utterances FROM templated t JOIN aliases a USING (app_display_name)
  QUALIFY row_number() OVER (PARTITION BY alias ORDER BY {digest(SEED + '/alias', 'command')}) = 1)"""

MENTIONS = "(contains(lower(description), lower(app_display_name)) OR contains(lower(description), lower(app)))"

LINE_CMDS = f"""
lc AS (SELECT DISTINCT 'o' || l_orderkey app, l_returnflag object, ({OPS_SQL})[l_linenumber] op FROM lineitem)"""

FRAME3 = f"base AS (SELECT utterances, commands FROM s3 WHERE list_bool_and(list_transform(string_split(app_list, ','), lambda a: contains(utterances, a))))"


def numbered(source: str, keys: str, *ties: str) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY {digest('order', *ties)}, {', '.join(ties)}) - 1 i, count(*) OVER () n FROM {source}"


def lcs(source: str) -> str:
    """Recursive CTEs ``lcs(a, b, d)``: LCS length of the distinct pairs of ``source``."""
    step = "list_transform(range(1, len(row_) + 1), lambda t: greatest(row_[t], CASE WHEN t > 1 THEN row_[t - 1] ELSE 0 END * 0 + CASE WHEN a[t] = b[j + 1] THEN (CASE WHEN t > 1 THEN row_[t - 1] ELSE 0 END) + 1 ELSE 0 END))"
    return f"""
pr AS (SELECT DISTINCT a, b FROM {source}),
dp AS (SELECT a, b, 0 j, list_transform(range(length(a)), lambda x: 0) row_ FROM pr
  UNION ALL SELECT a, b, j + 1, list_transform(range(1, len(st) + 1), lambda t: list_max(st[1:t])) FROM (SELECT a, b, j, {step} st FROM dp WHERE j < length(b))),
lcs AS (SELECT a, b, row_[len(row_)] l FROM dp WHERE j = length(b))"""


def prompt(layout: str, lines: str, apps: str = "") -> str:
    template = PROMPT_LAYOUTS[layout].replace("{eos}", "</s>").replace("{{apps}}", "{" + apps + "}")
    out = _lit(template)
    for slot in ("{pairs}", "{paths}"):
        out = out.replace(slot, f"' || {lines} || '")
    return out.replace("{u}", "' || utterances || '")


REPLIES = "replies AS (SELECT conv_id, turn, 'conv.' || conv_id || '.' || turn path, text FROM conversations WHERE role = 'assistant')"


def oracle_sql() -> dict[str, str]:
    cat, wide = catalog(), catalog(True)
    sql: dict[str, str] = {}
    sql["catalog_commands"] = _with(cat) + "SELECT command, app, object, op, kind, description, app_display_name, object_display_name, operation_display_name, kind = 'triggers' is_trigger FROM cmds"
    sql["op_kind_rollup"] = _with(wide) + "SELECT app, object, string_agg(DISTINCT kind, ',' ORDER BY kind) op_types FROM cmds GROUP BY app, object"
    sql["apps_by_product"] = _with(PRODUCTS) + "SELECT product, app FROM products"
    sql["apps_for_target"] = _with(PRODUCTS) + "SELECT app FROM products WHERE product = 'server'"
    sql["missing_apps"] = _with(cat, PRODUCTS) + "SELECT DISTINCT app FROM products WHERE app NOT IN (SELECT app FROM cmds)"
    sql["type_counts"] = _with(cat, SILVER) + "SELECT 'app' typename, count(*) n FROM a UNION ALL SELECT 'bo', count(*) FROM o UNION ALL SELECT 'op', count(*) FROM op"
    sql["element_ids"] = _with(wide, SILVER, PRODUCTS, ELEMENTS) + "SELECT * FROM elements"
    sql["elements_by_name"] = _with(cat, SILVER, PRODUCTS, ELEMENTS) + (
        "SELECT full_name, typename, element_id, parent_id FROM elements WHERE typename = 'op' "
        "UNION ALL SELECT lower(s_name), NULL, NULL, NULL FROM supplier"
    )
    sql["graph_vertices"] = _with(cat, SILVER) + (
        "SELECT 'app' label, app full_name, app AS name, display_name, '' description FROM a "
        "UNION ALL SELECT 'bo', app || '/' || object, object, display_name, 'All about ' || display_name FROM o "
        "UNION ALL SELECT 'op', app || '/' || object || '/' || op, op, display_name, description FROM op"
    )
    edges = (
        "SELECT 'business_object' edge, app src, app || '/' || object dst FROM o "
        "UNION ALL SELECT 'operation', app || '/' || object, app || '/' || object || '/' || op FROM op"
    )
    sql["graph_edges"] = _with(cat, SILVER) + edges
    sql["graph_counts"] = _with(wide, SILVER) + (
        "SELECT 'vertex:app' part, count(*) n FROM a UNION ALL SELECT 'vertex:bo', count(*) FROM o UNION ALL SELECT 'vertex:op', count(*) FROM op "
        f"UNION ALL SELECT 'edge:' || edge, count(*) FROM ({edges}) GROUP BY edge"
    )
    sql["catalog_audit"] = _with(cat, PRODUCTS) + (
        "SELECT DISTINCT 'no product' problem, app AS name FROM (SELECT app FROM cmds UNION ALL SELECT lower(n_name) FROM nation) WHERE app NOT IN (SELECT app FROM products) "
        "UNION ALL SELECT DISTINCT 'no kind', app || '/' || object || '/' || op FROM cmds WHERE op LIKE '%POLLER'"
    )
    sql["first_account_per_app"] = "SELECT n_name app, arg_min(c_name, c_custkey) account, count(*) n_accounts FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
    sql["account_gaps"] = (
        "WITH a AS (SELECT DISTINCT c_custkey app FROM customer), b AS (SELECT o_custkey app FROM orders UNION SELECT -p_partkey FROM part) "
        "SELECT app, 'no account' gap FROM a WHERE app NOT IN (SELECT app FROM b) UNION ALL SELECT app, 'no application' FROM b WHERE app NOT IN (SELECT app FROM a)"
    )
    sql["accounts_by_app"] = "SELECT c_nationkey app, c_name account FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey < 3"
    # JSON
    sql["json_apps"] = _with(cat, PRODUCTS, JSON) + "SELECT app, CASE WHEN nested THEN 'nested' ELSE 'flat' END dialect, display_name, description, products FROM japp LEFT JOIN plist USING (app)"
    sql["json_objects"] = _with(cat, JSON) + (
        "SELECT app, object, CASE WHEN nested THEN coalesce(own_display, inner_display) ELSE own_display END display_name, description, "
        "coalesce((SELECT string_agg(DISTINCT kind, ',' ORDER BY kind) FROM jop WHERE jop.app = jobj.app AND jop.object = jobj.object), 'actions,triggers') op_types, has_schema FROM jobj"
    )
    sql["json_commands"] = _with(cat, JSON) + (
        "SELECT j.command, j.app, j.object, j.op, j.kind, j.description, j.app_display_name, "
        "CASE WHEN o.nested THEN coalesce(own_display, inner_display) ELSE own_display END object_display_name, j.operation_display_name "
        "FROM jop j JOIN jobj o USING (app, object)"
    )
    sql["json_properties"] = _with(cat, JSON, JPROPS) + """SELECT app, object, op, direction, p.prop_path, p."type" FROM jdir
  JOIN (VALUES (true, 'id', 'string'), (true, 'owner.name', 'string'), (true, 'tags.label', 'string'),
    (false, 'owner', '{"age":{"type":"int"},"name":{"type":"string"}}'), (false, 'tags', '[{"label":{"type":"string"}}]')) p(inc, prop_path, "type") ON p.inc = included"""
    sql["json_object_properties"] = _with(cat, JSON) + (
        "SELECT app, object, unnest(['id', 'owner', 'tags']) prop, unnest(['string', '{\"age\":{\"type\":\"int\"},\"name\":{\"type\":\"string\"}}', "
        "'[{\"label\":{\"type\":\"string\"}}]']) AS \"type\" FROM jobj WHERE has_schema"
    )
    sql["json_quarantine"] = _with(cat, JSON) + (
        "SELECT 'listing' document, app, count(DISTINCT object) n FROM jn WHERE broken GROUP BY app "
        "UNION ALL SELECT 'schema', app, count(DISTINCT object) FROM jn WHERE NOT nested AND object = 'plate' AND op <> 'DELETED' GROUP BY app"
    )
    sql["json_orphans"] = _with(cat, JSON) + "SELECT DISTINCT app || '-old' app, object FROM jl"
    sql["quality_warnings"] = _with(cat, JSON) + """SELECT app AS name, 'no description' warnings FROM japp WHERE description IS NULL
  UNION ALL SELECT app || '/' || object, concat_ws(', ',
    CASE WHEN coalesce(own_display, '?') <> inner_display THEN 'label-conflict: ' || coalesce(own_display, '-') || ' | ' || inner_display END,
    CASE WHEN own_display IS NULL THEN 'no displayName, display.name used' END,
    CASE WHEN description IS NULL THEN 'no description' END) FROM jobj
  WHERE nested AND (coalesce(own_display, '?') <> inner_display OR description IS NULL)"""
    sql["json_interaction_diff"] = _with(cat, JSON) + (
        "SELECT DISTINCT l.app, l.object, l.op, 'summary only' side FROM jl l JOIN jschema USING (app, object) WHERE l.op = 'DELETED'"
    )
    sql["missing_labels"] = "SELECT doc_id, 'no quality, no toxic' warnings FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
    sql["complete_rows"] = "SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)"
    sql["interaction_diff"] = (
        "SELECT c_custkey AS key, 'summary only' side FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events) "
        "UNION ALL SELECT DISTINCT user_id, 'schema only' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)"
    )
    sql["interaction_diff_all"] = (
        "SELECT doc_id, 'summary only' side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) "
        "UNION ALL SELECT doc_id, 'schema only' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"
    )
    sql["flatten_nested"] = _with(cat) + "SELECT command path, description, app_display_name FROM cmds"
    sql["event_props_path"] = """SELECT event_id, p.path, CASE p.path WHEN 'outer.inner.k' THEN (props->>'$.k') WHEN 'flat.k' THEN (props->>'$.k')
    WHEN 'flat' THEN '{"type":' || replace(props, ' ', '') || '}' END AS value
  FROM events, (SELECT unnest(['outer.inner.k', 'flat.k', 'flat', 'outer.k', 'none.k']) path) p"""
    sql["event_props"] = "SELECT event_id, 'k' AS key, (props->>'$.k')::BIGINT AS value FROM events"
    stored = """WITH now AS (SELECT max(ts) now FROM events),
incoming AS (SELECT user_id app, event_type object, max(ts) modified, count(*) payload FROM events GROUP BY ALL),
cur AS (SELECT user_id app, event_type object, CASE WHEN floor(sum(value)) % 2 = 0 THEN max(ts) ELSE min(ts) END modified, -count(*) payload
  FROM events WHERE event_type <> 'error' GROUP BY ALL),
capps AS (SELECT app, min(modified) modified FROM cur WHERE object <> 'click' GROUP BY app)"""
    sql["app_refresh"] = stored + """, old AS (SELECT app, modified, epoch_us(now) - epoch_us(modified) <= 86400000000 * 9 fresh FROM capps, now)
SELECT app, strftime(coalesce(CASE WHEN fresh THEN modified END, now), '%Y-%m-%d %H:%M:%S') modified, NOT coalesce(fresh, false) refreshed
FROM (SELECT DISTINCT user_id app FROM events) LEFT JOIN old USING (app), now"""
    sql["stale_refresh"] = stored + """,
fresh AS (SELECT app FROM capps, now WHERE epoch_us(now) - epoch_us(modified) <= 86400000000 * 9),
taken AS (SELECT i.app, i.object, i.payload FROM incoming i LEFT JOIN cur c ON c.app = i.app AND c.object = i.object, now
  WHERE i.app NOT IN (SELECT app FROM fresh) AND (c.modified IS NULL OR epoch_us(now) - epoch_us(c.modified) > 86400000000 * 20))
SELECT app, object, payload, false refreshed FROM cur WHERE (app, object) NOT IN (SELECT (app, object) FROM taken)
UNION ALL SELECT app, object, payload, true FROM taken"""
    # utterances and samples
    cols = "command, source, description, app, object, op, app_display_name, object_display_name, app_list"
    sql["triplet_utterances"] = _with(cat, utt()) + f"SELECT {cols} FROM utt"
    sql["triplet_utterances_wide"] = _with(wide, utt()) + f"SELECT {cols} FROM utt"
    sql["weighted_sample"] = _with(wide, utt(), drawn("d", "1")) + "SELECT command, source, description FROM d"
    sql["packed_sample"] = _with(wide, utt(), drawn("d", "1"), drawn("e", "2")) + "SELECT '1' stream, command, source, description FROM d UNION ALL SELECT '2', command, source, description FROM e"
    sql["display_names"] = _with(wide, utt(), "narrow AS (" + _with(cat) + "SELECT command, app_display_name, object_display_name FROM cmds)") + (
        "SELECT utt.command, source, n.app_display_name, n.object_display_name FROM utt LEFT JOIN narrow n ON n.command = utt.command"
    )
    sql["fraction_sample"] = f"SELECT o_orderkey FROM orders WHERE {u(SEED, 'o_orderkey')} < 0.1"
    sql["pick_per_group"] = f"SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY {digest(SEED, 'l_orderkey', 'l_linenumber', 'l_partkey')}) = 1"
    sql["cap_per_group"] = f"SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY {digest(SEED, 'o_orderkey')}) <= 250"
    sql["pick_n_rows"] = f"SELECT c_custkey, c_name FROM customer ORDER BY {digest(SEED, 'c_custkey')} LIMIT 25"
    sql["zip_resample"] = f"""WITH o AS ({numbered('orders', '', 'o_orderkey')}),
c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY {digest('order', 'c_custkey')}, c_custkey) - 1 i, count(*) OVER (PARTITION BY c_nationkey) n FROM customer),
pool AS (SELECT c.c_custkey, c.c_nationkey, d.pool_draw FROM (SELECT DISTINCT c_nationkey, n FROM c) g, (SELECT unnest(range(4)) pool_draw) d
  JOIN c ON c.c_nationkey = g.c_nationkey AND c.i = {idx('g.n', SEED + '/pool', 'g.c_nationkey', 'd.pool_draw')}),
pn AS ({numbered('pool', '', 'c_nationkey', 'pool_draw')}),
draws AS (SELECT unnest(range(1000)) draw)
SELECT d.draw, o.o_orderkey, pn.c_custkey FROM draws d
JOIN o ON o.i = {idx('o.n', SEED + '/left', 'd.draw')} JOIN pn ON pn.i = {idx('pn.n', SEED + '/right', 'd.draw')}"""
    for t in range(1, 9):
        sql[f"samples_type{t}"] = _sample(t)
    sql["samples_type3_many"], sql["samples_type4_many"] = (_sample(t, many=True) for t in (3, 4))
    sql["sample_corpus"] = _corpus()
    sql["pair_sampler_wide"] = _sample(2, wide=True)
    sql["same_object_pairs"] = (
        "WITH p AS (SELECT DISTINCT replace(lower(p_brand), '#', '') app, lower(p_name || p_size) bo FROM part) "
        "SELECT a.bo, a.app app_a, b.app app_b FROM p a JOIN p b ON a.bo = b.bo AND a.app <> b.app"
    )
    # groups
    sql["distinct_text_index"] = "SELECT md5(lower(text)) text_key, min(doc_id) first_element, count(DISTINCT doc_id) n_elements FROM documents WHERE length(text) > 0 GROUP BY 1"
    sql["text_postings"] = "SELECT DISTINCT md5(lower(text)) text_key, doc_id FROM documents WHERE length(text) > 0"
    sql["distinct_objects"] = _with(wide, utt()) + "SELECT DISTINCT app || '.' || object objects, app, object FROM utt"
    sql["object_names"] = _with(wide, utt(), OBJECTS) + "SELECT * FROM objs"
    sql["recurring_objects"] = _with(wide, utt()) + "SELECT lower(object) bo, count(DISTINCT app) n FROM utt GROUP BY 1 HAVING count(DISTINCT app) > 1"
    sql["unique_objects"] = _with(wide) + "SELECT min(app) app, min(object) object FROM (SELECT DISTINCT app, object FROM cmds) GROUP BY rtrim(lower(object), 's') HAVING count(*) = 1"
    sql["single_object_apps"] = _with(LINE_CMDS) + "SELECT app, min(object) object FROM lc GROUP BY app HAVING count(DISTINCT object) = 1"
    named = "named AS (SELECT *, regexp_replace(lower(object_display_name), 's$', '') lemma FROM utt), amb AS (SELECT lemma, count(DISTINCT app_display_name) n_apps FROM named GROUP BY 1 HAVING count(DISTINCT app_display_name) > 1)"
    sql["ambiguous_objects"] = _with(cat, utt(), named) + "SELECT * FROM amb"
    sql["ambiguity_report"] = _with(cat, utt(), named) + "SELECT DISTINCT lemma, n_apps, app_display_name, command, op AS method FROM named JOIN amb USING (lemma)"
    sql["group_lists"] = f"SELECT o_custkey, o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {digest('list', 'o_orderkey')}, o_orderkey) - 1 AS position FROM orders"
    sql["last_per_group"] = "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"
    sql["first_per_group"] = "SELECT o_custkey, min(o_orderkey) o_orderkey, o_orderpriority FROM orders GROUP BY o_custkey, o_orderpriority"
    sql["matching_rows"] = "SELECT o_orderkey, o_custkey, c_mktsegment = 'MACHINERY' kept FROM orders JOIN customer ON c_custkey = o_custkey"
    # paraphrases and evaluation sets
    treated = f"\"type\" IN ({', '.join(map(str, PARAPHRASED_TYPES))})"
    sql["paraphrase_requests"] = _with(TEST) + (
        f"SELECT conv_id, turn, \"type\", 'Examples of ' || (SELECT arg_max(lower(c_mktsegment), 't_' || c_mktsegment) FROM customer) || "
        f"{_lit(chr(10) * 2 + 'Phrase:' + chr(10))} || rtrim(utterances, '.') || {_lit('.' + chr(10) + 'Paraphrase:' + chr(10))} request FROM test WHERE {treated}"
    )
    sql["accepted_paraphrases"] = _with(TEST) + (
        f"SELECT conv_id, turn, \"type\", CASE WHEN {treated} THEN CASE WHEN conv_id % 3 <> 0 THEN split_part(commands, '.', 1) || '.' ELSE rtrim(utterances, '.') || '.' END END paraphrased_utterances FROM test"
    )
    windows = """
src AS (SELECT p_partkey, p_name || ' ' || lower(p_type) text, unnest([string_split(p_name, ' ')[2], lower(p_brand)]) app, unnest([1, 2]) k FROM part),
txt AS (SELECT DISTINCT text, app, CASE WHEN length(text) <= length(app) THEN text ELSE app END s, CASE WHEN length(text) <= length(app) THEN app ELSE text END l FROM src),
win AS (SELECT text, app, s a, substr(l, unnest(range(1, length(l) + 1)), length(s)) b FROM txt)"""
    sql["paraphrase_scores"] = _with(windows, lcs("win")) + (
        ", best AS (SELECT text, app, floor(max(200.0::DOUBLE * l / (length(a) + length(b))) + 0.5)::INT r FROM win JOIN lcs USING (a, b) GROUP BY text, app) "
        "SELECT p_partkey, string_agg(r, ',' ORDER BY k) partial_ratios FROM src JOIN best USING (text, app) GROUP BY p_partkey"
    )
    mention_windows = """
src AS (SELECT command, source, description, lower(description) text, lower(app) app FROM utt),
txt AS (SELECT DISTINCT text, app, CASE WHEN length(text) < length(app) THEN text ELSE app END s, CASE WHEN length(text) < length(app) THEN app ELSE text END l FROM src),
win AS (SELECT text, app, s a, substr(l, unnest(range(1, length(l) + 1)), length(s)) b FROM txt)"""
    mentions = _with(cat, utt(), mention_windows, lcs("win"), """
best AS (SELECT text, app, floor(max(200.0::DOUBLE * l / (length(a) + length(b))) + 0.5)::INT r FROM win JOIN lcs USING (a, b) GROUP BY text, app)""")
    sql["mentions_app_all"] = mentions + "SELECT command, source, r app_score, r > 80 mentions FROM src JOIN best USING (text, app)"
    sql["mentions_app"] = mentions + "SELECT command, source, description, r app_score FROM src JOIN best USING (text, app) WHERE r > 80"
    sql["first_sentences"] = "SELECT doc_id, split_part(text, '.', 1) || '.' sentence FROM documents"
    sql["alias_eval"] = _with(cat, utt(None), ALIAS_EVAL) + "SELECT utterances, command commands FROM al"
    sql["templated_aliases"] = _with(cat, utt(None), ALIASES, TEMPLATED) + (
        "SELECT command, templated, (SELECT string_agg(alias, ',' ORDER BY alias) FROM aliases a WHERE a.app_display_name = t.app_display_name) aliases FROM templated t"
    )
    unique_final = "SELECT replace(templated, ' ' || p.app_display_name, '') utterances, p.command commands FROM picked p LEFT JOIN templated t USING (command)"
    sql["unique_object_eval"] = _with(wide, utt(None), TEMPLATED, UNIQUE_EVAL) + unique_final
    template = " ".join(f"WHEN '{o}' THEN {_lit(t)}" for o, t in TEMPLATES.items())
    sql["single_object_eval"] = _with(LINE_CMDS, f"""
single AS (SELECT app FROM lc GROUP BY app HAVING count(DISTINCT object) = 1),
cmds AS (SELECT app || '.' || object || '.' || op command, app, object, op, '' description, upper(app) app_display_name, 'Flag ' || object object_display_name,
    lower(op) || ' it' operation_display_name, CASE op {template} END template FROM lc SEMI JOIN single USING (app))""", utt(None)) + (
        "SELECT arg_min(replace(replace(description, ' ' || app, ''), ' ' || upper(app), ''), source) utterances, command commands FROM utt GROUP BY command"
    )
    sql["mentions_actions"] = _with(cat) + f"SELECT command, description FROM cmds WHERE {MENTIONS} AND kind = 'actions'"
    sql["mentions_triggers"] = _with(cat) + f"SELECT command, description FROM cmds WHERE {MENTIONS} AND kind = 'triggers'"
    ctes3, final3 = sample_type(3)
    sql["composed_eval"] = _with(cat, utt(), ctes3, f"s3 AS ({final3})", FRAME3, f"""
bn AS ({numbered('base', '', 'commands', 'utterances')}),
act AS (SELECT *, row_number() OVER (PARTITION BY app_display_name ORDER BY {digest('order', 'command')}, command) - 1 i, count(*) OVER (PARTITION BY app_display_name) n
  FROM (SELECT app_display_name, command, {verb_first('description')} action_text FROM cmds WHERE {MENTIONS} AND kind = 'actions')),
pool AS (SELECT g.app_display_name, act.command, act.action_text, d.pool_draw FROM (SELECT DISTINCT app_display_name, n FROM act) g, (SELECT unnest(range(4)) pool_draw) d
  JOIN act ON act.app_display_name = g.app_display_name AND act.i = {idx('g.n', SEED + '/pool', 'g.app_display_name', 'd.pool_draw')}),
pn AS ({numbered('pool', '', 'app_display_name', 'pool_draw')})""") + f"""
SELECT rtrim(replace(bn.utterances, ' and ', ', '), '.') || ' and ' || pn.action_text utterances, bn.commands || {NL} || pn.command commands
FROM (SELECT unnest(range(1000)) draw) d JOIN bn ON bn.i = {idx('bn.n', SEED + '/samples', 'd.draw')} JOIN pn ON pn.i = {idx('pn.n', SEED + '/actions', 'd.draw')}"""
    sql["trigger_composed_eval"] = _with(cat, utt(), ctes3, f"s3 AS ({final3})", FRAME3, f"""
tn AS (SELECT command, description, row_number() OVER (ORDER BY {digest('order', 'command')}, command) - 1 i, count(*) OVER () n FROM cmds WHERE {MENTIONS} AND kind = 'triggers')""") + f"""
SELECT ({trigger_phrase('tn.description')}) || ' and ' || {rest('b.utterances')} utterances, tn.command || {NL} || b.commands commands
FROM base b JOIN tn ON tn.i = {idx('tn.n', SEED + '/trigger', 'b.commands', 'b.utterances')}"""
    sql["text_records_eval"] = _with(records(True)) + "SELECT conv_id, record, utterances, commands FROM pairs"
    sql["text_records_plain"] = _with(records(False)) + (
        "SELECT conv_id, record, CASE WHEN suffix(sample, '<|endoftext|>') THEN sample ELSE sample || '<|endoftext|>' END sample FROM samples"
    )
    sql["eval_sets"] = (
        f"SELECT commands, utterances, 1 \"type\" FROM ({sql['alias_eval']}) UNION ALL SELECT commands, utterances, 2 FROM ({sql['unique_object_eval']}) "
        f"UNION ALL SELECT commands, utterances, 3 FROM ({sql['single_object_eval']}) UNION ALL SELECT commands, utterances, 4 FROM ({sql['composed_eval']}) "
        f"UNION ALL SELECT commands, utterances, 6 FROM ({sql['text_records_eval']})"
    )
    # fuzzy
    src = "src AS (SELECT DISTINCT p_name a, lower(p_brand) || ' ' || lower(p_type) b FROM part)"
    dd = "length(a) + length(b) - 2 * l"
    sql["indel_pairs"] = _with(src, lcs("src")) + f"SELECT a, b, ({dd})::INT distance, round(1 - ({dd})::DOUBLE / (length(a) + length(b)), 6) similarity FROM lcs"
    sql["indel_pairs_native"] = _with(src, lcs("src")) + f"SELECT a, b, ({dd})::INT distance FROM lcs"
    # vectors
    sql["knn_exact"] = sql["knn_streamed"] = sql["knn_cells_exact"] = knn()
    sql["knn_filtered"] = knn("c.typename IN ('bo', 'op') AND list_contains(c.op_types, 'triggers') AND list_contains(c.products, 'cloud')")
    sql["knn_within_parent"] = knn("q.parent_id = c.parent_id", 3)
    sql["candidates_of_hits"] = _with(TREE, f"""
h1 AS (SELECT request_id, vec_id app_id FROM (SELECT request_id, c.vec_id,
    row_number() OVER (PARTITION BY request_id ORDER BY {dist('r.v', 'c.v')}, c.vec_id) k FROM req r, tree c WHERE typename = 'app') WHERE k <= 5)""") + (
        "SELECT request_id query_id, vec_id candidate, 'app' || vec_id % 25 || '/bo' || vec_id full_name FROM h1 JOIN tree ON parent_id = app_id AND typename = 'bo'"
    )
    sql["candidate_rows_of_hits"] = _with(TREE, f"""
h1 AS (SELECT request_id, vec_id app_id FROM (SELECT request_id, c.vec_id,
    row_number() OVER (PARTITION BY request_id ORDER BY {dist('r.v', 'c.v')}, c.vec_id) k FROM req r, tree c WHERE typename = 'app') WHERE k <= 5)""") + (
        "SELECT request_id query_id, parent_id, vec_id candidate FROM h1 JOIN tree ON parent_id = app_id AND typename = 'bo'"
    )
    sql["match_hierarchy"] = match("true")
    sql["match_product"] = match("list_contains(products, 'cloud')")
    sql["request_rewrite"] = """WITH r AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'slack' ELSE 'box' END app, CASE WHEN event_type = 'click' THEN 'slash command' ELSE event_type END object,
    CASE WHEN value < 10 THEN 'new' WHEN value < 20 THEN 'new row' ELSE 'newest' END op, CASE WHEN user_id % 3 = 0 THEN 'triggers' ELSE 'actions' END kind FROM events)
SELECT event_id, app, CASE WHEN app = 'slack' AND object = 'slash command' THEN 'message' ELSE object END object,
    CASE WHEN kind = 'triggers' AND (op = 'new' OR op LIKE 'new %') THEN 'CREATED' ELSE op END op, kind FROM r"""
    sql["cosine_pairs"] = """WITH c AS (SELECT label, arg_min(embedding::DOUBLE[], vec_id) centre FROM embeddings GROUP BY label)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], centre), 6) similarity FROM embeddings JOIN c USING (label)"""
    sql["catalog_descriptions"] = _with(cat, JSON) + """SELECT DISTINCT full_name, typename, description FROM (
  SELECT app full_name, 'app' typename, unnest([app, display_name, description]) description FROM japp
  UNION ALL SELECT app || '/' || object, 'bo', unnest([object, coalesce(own_display, inner_display), description, CASE WHEN nested THEN inner_display END,
    CASE WHEN nested THEN 'All about ' || shown END]) FROM jobj
  UNION ALL SELECT app || '/' || object || '/' || op, 'op', unnest([op, operation_display_name, description]) FROM jop) WHERE description IS NOT NULL AND description <> ''"""
    sql["embed_hash"] = _with(*encoded("e", "(SELECT DISTINCT doc_id id, text FROM documents)", 64)) + (
        "SELECT doc_id, position, round(value, 6) AS value FROM e JOIN documents ON doc_id = id WHERE length(text) > 0"
    )
    document = f"command || {_lit(DOCUMENT_SEPARATOR)} || coalesce(description, '')"
    sql["corpus_rows"] = _with(cat, *encoded("e", f"(SELECT command id, {document} AS text FROM cmds)", 32)) + (
        "SELECT command path, description, app_display_name, position, round(value, 6) AS value FROM e JOIN cmds ON command = id"
    )
    pair = "(SELECT conv_id || '/' || turn id, {} AS text FROM test)"
    sql["cosine_texts"] = _with(TEST, *encoded("a", pair.format("utterances"), 64), *encoded("b", pair.format("commands"), 64)) + """
SELECT conv_id, turn, round(coalesce((SELECT sum(a.value * b.value) FROM a JOIN b USING (id, position) WHERE id = conv_id || '/' || turn)
  / (SELECT sqrt(sum(value * value)) FROM a WHERE id = conv_id || '/' || turn) / (SELECT sqrt(sum(value * value)) FROM b WHERE id = conv_id || '/' || turn), 0), 6) similarity FROM test"""
    found = _with(cat, TEST, *encoded("c", f"(SELECT command id, {document} AS text FROM cmds)", 64),
        *encoded("q", "(SELECT DISTINCT utterances id, utterances AS text FROM test WHERE length(utterances) > 0)", 64), f"""
qn AS (SELECT id, sqrt(sum(value * value)) n FROM q GROUP BY id), cn AS (SELECT id, sqrt(sum(value * value)) n FROM c GROUP BY id),
dots AS (SELECT q.id asked, c.id path, sum(q.value * c.value) s FROM q JOIN c USING (position) GROUP BY ALL),
near AS (SELECT asked, path, round(1 - coalesce(s / qn.n / cn.n, 0), 9) distance FROM (SELECT DISTINCT utterances asked FROM test WHERE length(utterances) > 0)
  CROSS JOIN (SELECT command path FROM cmds) LEFT JOIN dots USING (asked, path) LEFT JOIN qn ON qn.id = asked LEFT JOIN cn ON cn.id = path),
best AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY distance, path) rank FROM near QUALIFY rank <= 5)""")  # fmt: skip
    sql["retrieved_documents"] = found + f"""SELECT conv_id, turn, rank, path, {document} document, round(distance, 6) distance
FROM test JOIN best ON asked = utterances JOIN cmds ON command = path"""
    sql["retrieved_hits"] = found + r""", r AS (SELECT conv_id, turn, commands, path, rank FROM test JOIN best ON asked = utterances),
l AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN path ELSE commands END commands FROM r WHERE rank = 3)
SELECT conv_id, turn, bool_or(list_contains(regexp_extract_all(l.commands, '([\w.\-]+)', 1), r.path)) hit FROM l JOIN r USING (conv_id, turn) GROUP BY ALL"""
    # scores
    sql["hit_at_5"] = f"""WITH n AS (SELECT q.vec_id query_id, q.label ql, c.label cl, row_number() OVER (PARTITION BY q.vec_id ORDER BY {dist('q.embedding::DOUBLE[]', 'c.embedding::DOUBLE[]')}, c.vec_id) k
  FROM embeddings q, embeddings c WHERE q.vec_id <> c.vec_id) SELECT query_id, bool_or(ql = cl) hit FROM n WHERE k <= 5 GROUP BY query_id"""
    sql["exact_match_rows"] = _with(TEST, SCORED) + "SELECT conv_id, turn, response, exact FROM scored"
    sql["exact_match_report"] = _with(TEST, SCORED) + 'SELECT "type", subtype, count(*) n, sum(exact::INT)::BIGINT n_exact FROM scored GROUP BY ALL'
    sql["evaluation_report"] = _with(TEST, SCORED) + (
        'SELECT "type", subtype, count(*) n, sum(exact::INT)::BIGINT n_exact, '
        "sum((conv_id % 2 = 0 AND list_contains(regexp_extract_all(label, '([\\w.\\-]+)', 1), regexp_extract(commands, '([\\w.\\-]+)', 1)))::INT)::BIGINT n_hit "
        "FROM scored GROUP BY ALL"
    )
    sql["token_counts"] = "SELECT doc_id, len(regexp_extract_all(text, '(\\w+|[^\\w ])', 1)) n_tokens FROM documents"
    lines = "coalesce((SELECT string_agg('    ' || path || chr(10), '' ORDER BY r.turn) FROM replies r WHERE r.conv_id = test.conv_id AND (r.turn + 1) // 2 <= 5), '')"
    sql["prompt_rows"] = _with(TEST, REPLIES) + f"SELECT conv_id, turn, {prompt('paths', lines)} prompt FROM test"
    sql["prompt_rows_conversational"] = _with(TEST) + f"SELECT conv_id, turn, {prompt('conversational', '', 'alpha, beta')} prompt FROM test"
    sql["prompt_rows_all"] = _with(TEST, REPLIES) + f"SELECT conv_id, turn, {prompt('options', lines)} prompt FROM test"
    both = "coalesce((SELECT string_agg('    ' || text || ': ' || path || chr(10), '' ORDER BY r.turn) FROM replies r WHERE r.conv_id = test.conv_id AND (r.turn + 1) // 2 <= 5), '')"
    sql["prompt_rows_pairs"] = _with(TEST, REPLIES) + f"SELECT conv_id, turn, {prompt('pairs_and_apps', both, 'alpha, beta')} prompt FROM test"
    sql["prompt_rows_apps"] = _with(TEST) + f"SELECT conv_id, turn, {prompt('apps', '', 'alpha, beta')} prompt FROM test"
    sql["needs_app"] = _with(TEST) + (
        "SELECT conv_id, turn, app, utterances || ', I mean for ' || app || '. Output just triplet(s).' clarification FROM "
        "(SELECT *, string_split(split_part(commands, '.', 1), ' ')[-1] app FROM test) WHERE NOT contains(lower(utterances), lower(app))"
    )
    sql["split_documents"] = "SELECT doc_id, source path, length(text) n_chars, md5(text) digest FROM documents"
    sql["first_correct_round"] = (
        "SELECT conv_id, text generations, length(text) % 2 = 0 exact FROM conversations WHERE role = 'assistant' "
        "QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(text) % 2, turn) = 1"
    )
    return sql
