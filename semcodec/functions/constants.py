"""Fixed values that results depend on: code tables, word lists, patterns, weights."""

# --- fixed values: domain codes, their numbers and names -------------------------------------------------------------
DOMAINS = {
    "EM": (0x00, "Emotion"), "AC": (0x01, "Action"), "OB": (0x02, "Object"), "QU": (0x03, "Quality"), "AB": (0x04, "Abstract"),
    "NA": (0x05, "Nature"), "PE": (0x06, "Person"), "SP": (0x07, "Space"), "TM": (0x08, "Time"), "QT": (0x09, "Quantity"),
    "BD": (0x0A, "Body"), "SO": (0x0B, "Social"), "TC": (0x0C, "Tech"), "FD": (0x0D, "Food"), "CM": (0x0E, "Communication"),
    "SN": (0x0F, "Sensory"), "MV": (0x10, "Movement"), "RL": (0x11, "Relation"), "EC": (0x12, "Economy"),
    "CF": (0x20, "Control Flow"), "DS": (0x21, "Data Structure"), "TS": (0x22, "Type System"), "OP": (0x23, "Operation"), "IO": (0x24, "IO"),
    "ER": (0x25, "Error"), "PT": (0x26, "Pattern"), "MD": (0x27, "Module"), "TE": (0x28, "Testing"), "AP": (0x29, "API"), "IN": (0x2A, "Infrastructure"),
    "SC": (0x40, "Schema"), "TR": (0x41, "Transform"), "FM": (0x42, "Format"),
}
CODE_DOMAINS = (0x20, 0x2A)
NULL_ADDRESS = 0xFFFFFF
ROLES = {"AC": 2, "MV": 2, "QU": 3, "SN": 3, "RL": 4, "SP": 4, "TM": 4, "QT": 4}
DEFAULT_ROLE, FRAME_ROLE, FRAME_FEATURE, FRAME_SHADE = 1, 5, 2, 0x56

# --- fixed values: words of the text pipeline ------------------------------------------------------------------------
STOP_WORDS = (
    "a an the is am are was were be been being have has had having do does did doing i you he she it we they me him her us them "
    "my your his its our their this that these those and or but nor so yet in on at by for with from to of as into onto upon within without "
    "if then else than when where why how what who whom which would could should may might must shall will can not no yes there here "
    "out off over under up down all any some each every both either neither such same other another very too more most less least"
).split()
INTENSITY = {
    3: "extremely overwhelmingly devastatingly incredibly exceptionally tremendously".split(),
    2: "very highly deeply greatly really quite remarkably particularly".split(),
    1: "fairly rather moderately reasonably".split(),
    0: "somewhat slightly mildly barely hardly scarcely marginally".split(),
}
NEGATIONS = "not no never none nobody nothing nowhere neither nor without n't".split()
FORMAL = (
    "hereby thereof wherein whereas heretofore hereinafter aforementioned thus thereby hence moreover furthermore nevertheless "
    "notwithstanding pursuant accordingly henceforth respectively"
).split()

# --- fixed values: patterns of words and lexemes ---------------------------------------------------------------------
PLAIN_WORD = r"[A-Za-z][A-Za-z'-]*[A-Za-z]|[A-Za-z]"
CONTEXT_WORD = r"[a-z']+"
LEXEME = r"""(?s)#[^\n]*|//[^\n]*|/\*.*?\*/|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\b\d+(?:\.\d+)?\b|[A-Za-z_][A-Za-z0-9_]*|[+\-*/%<>=!&|^~?:;,.\(\)\[\]\{\}]"""

# --- fixed values: endings that a lemma is looked for without, and what takes their place; of nouns, verbs, adjectives --
DETACHED = [
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
    ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", ""),
    ("er", ""), ("est", ""), ("er", "e"), ("est", "e"),
]

# --- fixed values: relations and scoring -----------------------------------------------------------------------------
RELATIONS = "RELATED SYNONYM ISA PART PROPERTY USED_FOR CAUSES ENTAILS CONTEXT ANTONYM ROLE ASSOCIATED TOPIC".split()
RELATION_ALIASES = {
    "REL": "RELATED", "SYN": "SYNONYM", "IS_A": "ISA", "PART_OF": "PART", "PROP": "PROPERTY", "USE": "USED_FOR", "CAUSE": "CAUSES",
    "ENTAIL": "ENTAILS", "CTX": "CONTEXT", "ANTI": "ANTONYM", "ASSOC": "ASSOCIATED", "NB": "ASSOCIATED", "NUMBERBATCH": "ASSOCIATED", "TOPICAL": "TOPIC",
}
DIRECTIONS = {"OUT": 1, "FORWARD": 1, "SRC_TO_TGT": 1, "IN": 2, "REVERSE": 2, "TGT_TO_SRC": 2}
BASE_SCALE = {
    "RELATED": 0.85, "SYNONYM": 0.92, "ISA": 0.76, "PART": 0.68, "PROPERTY": 0.70, "USED_FOR": 0.72, "CAUSES": 0.66,
    "ENTAILS": 0.74, "CONTEXT": 0.58, "ROLE": 0.78, "ASSOCIATED": 0.42, "TOPIC": 0.35,
}
OTHER_SCALE = 0.72
PROFILES = {
    "base": {"antonym": 0.15, "scale": {}},
    "strict": {"antonym": 0.22, "scale": {"RELATED": 0.65, "SYNONYM": 0.96, "ISA": 0.85, "CONTEXT": 0.90, "PART": 0.50, "ASSOCIATED": 0.25, "TOPIC": 0.18}},
    "topical": {
        "antonym": 0.08,
        "hierarchy": 0.40,
        "scale": {"RELATED": 1.10, "SYNONYM": 0.82, "ISA": 0.78, "CONTEXT": 0.90, "PART": 0.82, "USED_FOR": 0.86, "PROPERTY": 0.78, "CAUSES": 0.74, "ENTAILS": 0.76, "ASSOCIATED": 0.80, "TOPIC": 0.98},
    },
    "sentence": {"antonym": 0.15, "coverage": True, "symmetric": True, "lexical": 0.68, "multiplier": 1.05, "scale": {"RELATED": 0.75, "SYNONYM": 1.05, "ASSOCIATED": 0.25, "TOPIC": 0.42}},
    "code_search": {"antonym": 0.08, "coverage": True, "lexical": 0.52, "scale": {"RELATED": 0.78, "SYNONYM": 0.90, "USED_FOR": 0.82, "ROLE": 0.84, "CONTEXT": 0.62, "ASSOCIATED": 0.30, "TOPIC": 0.28}},
}
GRAPH_POLICY = {
    "/r/Synonym": ("SYN", 1.20), "/r/SimilarTo": ("SYN", 1.10), "/r/RelatedTo": ("RELATED", 1.00), "/r/IsA": ("ISA", 0.95), "/r/InstanceOf": ("ISA", 0.90),
    "/r/HasA": ("PART", 0.85), "/r/PartOf": ("PART", 0.85), "/r/MadeOf": ("PART", 0.80), "/r/UsedFor": ("USED_FOR", 0.90), "/r/CapableOf": ("USED_FOR", 0.80),
    "/r/HasContext": ("CTX", 0.85), "/r/AtLocation": ("CTX", 0.75), "/r/HasProperty": ("PROP", 0.80), "/r/HasPrerequisite": ("CAUSES", 0.70),
    "/r/HasSubevent": ("ENTAILS", 0.70), "/r/HasFirstSubevent": ("ENTAILS", 0.65), "/r/HasLastSubevent": ("ENTAILS", 0.65), "/r/Causes": ("CAUSES", 0.70),
    "/r/CausesDesire": ("CAUSES", 0.65), "/r/MotivatedByGoal": ("CAUSES", 0.70), "/r/DerivedFrom": ("RELATED", 0.70), "/r/EtymologicallyRelatedTo": ("RELATED", 0.55),
    "/r/MannerOf": ("ISA", 0.75), "/r/DefinedAs": ("SYN", 0.85), "/r/FormOf": ("SYN", 0.80), "/r/Entails": ("ENTAILS", 0.75), "/r/HasSubclass": ("ISA", 0.85),
    "/r/Antonym": ("ANTI", 1.00), "/r/DistinctFrom": ("ANTI", 0.80),
}

# --- fixed values: frames, as (name, code, groups of words) ----------------------------------------------------------
FRAMES = [
    ("open_file", "TC320", ["open read load", "file filepath filename path"]),
    ("read_file", "TC321", ["read get load", "file source text string"]),
    ("count_rows", "TC322", ["count number len length", "row rows"]),
    ("excel_sheet", "TC323", ["excel worksheet sheet", "row rows cell column table"]),
    ("remove_characters", "AC520", ["remove delete strip clean", "character characters letter letters char chars"]),
    ("filter_numeric", "AC521", ["numeric number digit digits", "character characters string text"]),
    ("push_notification", "CM320", ["push send receive recieve notify notification notifications", "notification notifications notify listener listeners"]),
    ("latest_commit", "TC324", ["latest last head", "commit git repo repository"]),
    ("binary_search", "TC325", ["binary", "search find lookup"]),
    ("merge_sort", "TC326", ["merge", "sort sorted sorting"]),
    ("parse_json", "TC327", ["parse load read", "json"]),
    ("fetch_url", "TC328", ["fetch request open send get", "url http web response"]),
    ("tree_insert", "TC329", ["insert add", "tree node bst binary"]),
]

# --- fixed values: source code: file endings, keywords, abbreviations, patterns ---------------------------------------------------------------------------------------
EXTENSIONS = {
    "python": "py pyx pyi", "javascript": "js mjs cjs", "typescript": "ts tsx", "rust": "rs", "go": "go", "java": "java", "c": "c h", "cpp": "cpp cc cxx hpp hh",
}
KEYWORDS = {
    "python": (
        "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal "
        "not or pass raise return try while with yield match case self cls type isinstance issubclass super property staticmethod classmethod abstractmethod "
        "iter next len range enumerate zip map filter"
    ),
    "javascript": (
        "abstract async await break case catch class const continue debugger default delete do else enum export extends false finally for from function if "
        "implements import in instanceof interface let new null of private protected public return static super switch this throw true try typeof undefined "
        "var void while with yield"
    ),
    "typescript": (
        "abstract any as async await break case catch class const constructor continue debugger declare default delete do else enum export extends false "
        "finally for from function if implements import in instanceof interface is keyof let namespace new null number of private protected public readonly "
        "return static string super switch this throw true try type typeof undefined unknown var void while with yield infer satisfies never object symbol "
        "bigint module require global"
    ),
    "rust": (
        "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static "
        "struct super trait true type unsafe use where while lifetime box rc arc cell refcell vec vec! option result ok err some none unwrap expect derive "
        "default clone copy drop into from"
    ),
    "go": (
        "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch "
        "type var goroutine make new len cap append copy delete panic recover nil iota fmt println printf"
    ),
    "java": (
        "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if "
        "implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized "
        "this throw throws transient try void volatile while"
    ),
    "c": (
        "auto break case char const continue default do double else enum extern float for goto if int long register return short signed sizeof static struct "
        "switch typedef union unsigned void volatile while"
    ),
    "cpp": (
        "alignas alignof and asm auto bool break case catch char class compl const constexpr continue decltype default delete do double else enum explicit "
        "export extern false float for friend goto if inline int long mutable namespace new noexcept not nullptr operator or private protected public register "
        "return short signed sizeof static static_cast struct switch template this throw true try typedef typeid typename union unsigned using virtual void "
        "volatile while xor thread_local consteval concept requires co_await co_yield co_return shared_ptr unique_ptr make_shared"
    ),
}
ABBREVIATIONS = {
    "db": "database", "conn": "connection", "req": "request", "res": "response", "msg": "message", "btn": "button", "cfg": "config", "env": "environment",
    "auth": "authentication", "admin": "administrator", "api": "interface", "url": "address", "uri": "address", "err": "error", "fn": "function",
    "cb": "callback", "ctx": "context", "src": "source", "dst": "destination", "tmp": "temporary", "prev": "previous", "curr": "current", "idx": "index",
    "len": "length", "num": "number", "str": "string", "int": "integer", "bool": "boolean", "obj": "object", "arr": "array", "elem": "element",
    "attr": "attribute", "param": "parameter", "arg": "argument", "val": "value", "ref": "reference", "ptr": "pointer", "addr": "address", "doc": "document",
    "docs": "documents", "info": "information", "init": "initialize", "max": "maximum", "min": "minimum", "avg": "average", "calc": "calculate",
    "img": "image", "lib": "library", "pkg": "package", "mod": "module", "ver": "version", "regex": "pattern", "repo": "repository", "svc": "service",
    "cli": "interface", "ui": "interface", "ux": "interface", "id": "identifier", "uid": "identifier", "uuid": "identifier", "ws": "websocket", "ip": "address",
    "dir": "directory", "path": "path", "ext": "extension",
}
# --- fixed values: CODE_PATTERNS, patterns of lower-cased source, in RE2's syntax too ----------------------------------
CODE_PATTERNS = {
    "async-await": r"\b(async|await)\b",
    "error-handling": r"\b(try|catch|except|raise|throw|panic|recover|finally|rescue)\b",
    "loop-iteration": r"\b(for|while|foreach|range|enumerate|map|filter|reduce|fold)\b",
    "conditional-branch": r"\b(if|else|elif|switch|case|match|when|unless)\b",
    "network-request": r"\b(fetch|http|request|get\b|post|put|delete|axios|reqwest|urllib)\b",
    "file-io": r"\b(open|read|write|fopen|fread|fwrite|readfile|writefile|fs\.)\b",
    "database-crud": r"\b(select|insert|update|delete|where|from|join|query|sql)\b",
    "json-parse": r"\b(json|parse|stringify|unmarshal|marshal|loads|dumps|deserialize|serialize)\b",
    "class-oop": r"\b(class|extends|implements|interface|trait|new|self|super|this)\b",
    "function-def": r"\b(def\s+\w+|function\s+\w+|fn\s+\w+|func\s+\w+|public\s+\w+|private\s+\w+)\s*\(",
    "logging": r"\b(log|logger|console\.(log|warn|error|info|debug)|print|println|fmt\.print)",
    "collection-ops": r"\b(map|filter|reduce|sort|find|group|flatten|zip|push|pop|append|insert)\b\s*\(",
    "string-format": r"(\.format\(|f['\"]|sprintf|printf|fmt\.sprintf|template)",
    "auth-token": r"\b(auth|token|jwt|oauth|login|password|session|cookie|bearer)\b",
    "test-assert": r"\b(assert|expect|should|describe|it\s*\(|test\s*\(|context\s*\(|setup|teardown)\b",
}

# --- fixed values: SENSE_RELATIONS, a synset's relations to broader ones, narrower ones and derived forms by its part of speech (noun, verb, adjective, satellite, adverb), in order
SENSE_RELATIONS = {
    "up": {"n": "hypernym instance_hypernym", "v": "hypernym instance_hypernym verb_group", "as": "similar antonym pertainym derived", "r": "pertainym derived"},
    "down": {"nv": "hyponym instance_hyponym", "as": "also similar"},
    "derived": {"nvasr": "derived"},
}
