"""Rules by which facts are read from source text: fixed values, in expressions that Java and RE2 read alike (no lookaround, no word borders)."""

from __future__ import annotations

import tomllib
from typing import NamedTuple

#: Endings of source files and their languages.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "py": "python", "java": "java", "cs": "csharp",
    "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "kt": "kotlin", "kts": "kotlin", "c": "cpp", "cc": "cpp", "cpp": "cpp", "h": "cpp", "hpp": "cpp",
}

_TYPED = r"(?:public|private|protected|internal|static)[ \t]+(?:[A-Za-z_][A-Za-z0-9_<>\[\], ]*[ \t]+)?([A-Za-z_][A-Za-z0-9_]*)\("
_KEYWORD = r"function[ \t]+\*?[ \t]*([A-Za-z_][A-Za-z0-9_]*)"
_CLASS = r"(?:^|[\s;{}])(?:class|interface|enum)[ \t]+([A-Za-z_][A-Za-z0-9_]*)"
_QUOTED_IMPORT = r"(?:from|require\(|import)[ \t(]*['\"]([^'\"\n]+)['\"]"
#: What each language's parser reads: kind -> language -> expression, whose first group is the name.
SYMBOLS: dict[str, dict[str, str]] = {
    "function": {
        "python": r"(?:^|\n)[ \t]*(?:async[ \t]+)?def[ \t]+([A-Za-z_][A-Za-z0-9_]*)",
        "ruby": r"(?:^|\n)[ \t]*def[ \t]+(?:self\.)?([A-Za-z_][A-Za-z0-9_]*)",
        "go": r"(?:^|\n)func[ \t]+(?:\([^)\n]*\)[ \t]*)?([A-Za-z_][A-Za-z0-9_]*)",
        "rust": r"(?:^|[\s(])fn[ \t]+([A-Za-z_][A-Za-z0-9_]*)",
        "kotlin": r"(?:^|\s)fun[ \t]+([A-Za-z_][A-Za-z0-9_]*)",
        "php": _KEYWORD, "javascript": _KEYWORD, "typescript": _KEYWORD,
        "java": _TYPED, "csharp": _TYPED, "cpp": r"(?:^|\n)[A-Za-z_][A-Za-z0-9_:<>*& ]*[ \t*&]([A-Za-z_][A-Za-z0-9_]*)\([^;\n]*\)[ \t]*\{",
    },
    "class": {
        "python": r"(?:^|\n)[ \t]*class[ \t]+([A-Za-z_][A-Za-z0-9_]*)", "ruby": r"(?:^|\n)[ \t]*(?:class|module)[ \t]+([A-Za-z_][A-Za-z0-9_]*)",
        "go": r"(?:^|\n)type[ \t]+([A-Za-z_][A-Za-z0-9_]*)[ \t]+(?:struct|interface)", "rust": r"(?:^|\s)(?:struct|enum|trait)[ \t]+([A-Za-z_][A-Za-z0-9_]*)",
        **{k: _CLASS for k in ("kotlin", "php", "javascript", "typescript", "java", "csharp", "cpp")},
    },
    "import": {
        "python": r"(?:^|\n)[ \t]*(?:from|import)[ \t]+([A-Za-z_.][A-Za-z0-9_.]*)", "ruby": r"(?:^|\n)[ \t]*require(?:_relative)?[ \t]+['\"]([^'\"\n]+)['\"]",
        "go": r"(?:^|\n)[ \t]*import[ \t]+\"([^\"\n]+)\"", "rust": r"(?:^|\n)[ \t]*use[ \t]+([A-Za-z_][A-Za-z0-9_:]*)", "java": r"(?:^|\n)[ \t]*import[ \t]+([A-Za-z_][A-Za-z0-9_.]*)",
        "kotlin": r"(?:^|\n)[ \t]*import[ \t]+([A-Za-z_][A-Za-z0-9_.]*)", "csharp": r"(?:^|\n)[ \t]*using[ \t]+([A-Za-z_][A-Za-z0-9_.]*)", "php": r"(?:^|\n)[ \t]*use[ \t]+([A-Za-z_][A-Za-z0-9_\\]*)",
        "javascript": _QUOTED_IMPORT, "typescript": _QUOTED_IMPORT, "cpp": r"#include[ \t]+[<\"]([^>\"\n]+)[>\"]",
    },
    "call": {k: r"([A-Za-z_][A-Za-z0-9_]*)\(" for k in sorted(set(LANGUAGES.values()))},
    "decorator": {k: r"(?:^|\n)[ \t]*[@#]\[?([A-Za-z_][A-Za-z0-9_.]*)[(\]\n]" for k in ("python", "java", "kotlin", "typescript", "rust")},
    "handler": {
        "python": r"(?:^|\n)[ \t]*except[ \t]*([A-Za-z_.]*)", "ruby": r"(?:^|\n)[ \t]*rescue[ \t]*([A-Za-z_]*)", "go": r"if[ \t]+(err)[ \t]+!=[ \t]+nil", "rust": r"\.(unwrap|expect|map_err)\(",
        **{k: r"(catch)[ \t]*\(" for k in ("java", "kotlin", "csharp", "javascript", "typescript", "php", "cpp")},
    },
    "raise": {
        "python": r"(?:^|\n)[ \t]*raise[ \t]+([A-Za-z_][A-Za-z0-9_.]*)", "ruby": r"(?:^|\n)[ \t]*raise[ \t]+([A-Za-z_][A-Za-z0-9_]*)", "go": r"(panic|errors\.New|fmt\.Errorf)\(", "rust": r"(panic!|Err)\(",
        **{k: r"throw[ \t]+(?:new[ \t]+)?([A-Za-z_][A-Za-z0-9_]*)" for k in ("java", "kotlin", "csharp", "javascript", "typescript", "php", "cpp")},
    },
    "constant": {k: r"(?:^|\n)[ \t]*(?:export[ \t]+|public[ \t]+|private[ \t]+|static[ \t]+|final[ \t]+|const[ \t]+|val[ \t]+|let[ \t]+|var[ \t]+|[A-Za-z]+[ \t]+)?([A-Z][A-Z0-9_]{2,})[ \t]*(?::[^=\n]*)?=[^=]" for k in sorted(set(LANGUAGES.values()))},
    "literal": {k: r"\"([^\"\\\n]{3,})\"" for k in sorted(set(LANGUAGES.values()))},
}
#: Words before a parenthesis that call nothing.
NO_CALLS = "if for while switch return catch function def fn func fun class and or not in is elif unless until print sizeof typeof when match assert super this self new throw raise yield await async using lock foreach array list echo isset require include".split()

#: Generic node kinds: kind -> expression over all languages; counted for each file.
GENERIC = {
    "branch": r"(?:^|[\s;{}(])(?:if|elif|elsif|unless|switch|match|when|case)[\s(]", "loop": r"(?:^|[\s;{}(])(?:for|foreach|while|until|loop)[\s(]", "return": r"(?:^|[\s;{}])return[\s;(]",
    "assignment": r"[A-Za-z0-9_\])][ \t]*(?::=|[+\-*/]?=)[ \t]*[^=>\s]", "comparison": r"(?:===?|!==?|<=|>=)", "await": r"(?:^|[\s;{}(])await[\s(]", "lambda": r"(?:=>|->|lambda[ \t])",
    "comment": r"(?:^|\n)[ \t]*(?://|#|/\*|--)", "number": r"[^A-Za-z0-9_.]\d+(?:\.\d+)?", "text": r"(?:\"[^\"\n]*\"|'[^'\n]*')",
}


class Rule(NamedTuple):
    name: str
    pattern: str
    languages: tuple[str, ...] = ()  #: none: all


#: Category detectors, one for each category of findings.
DETECTORS = [
    Rule("accessibility", r"(?:aria-[a-z]+=|role=['\"]|tabindex=|alt=['\"])"), Rule("api", r"(?:@(?:Get|Post|Put|Delete)Mapping|(?:app|router)\.(?:get|post|put|delete)\(|fetch\()"),
    Rule("auth", r"(?:[aA]uthenticat|[aA]uthoriz|[lL]ogin\(|jwt|[sS]ession[A-Z_]|bearer)"), Rule("components", r"(?:React\.|useState\(|@Component|extends Component|<template>)"),
    Rule("config", r"(?:process\.env|os\.environ|getenv\(|System\.getProperty|ConfigurationManager|[lL]oadConfig)"), Rule("contracts", r"(?:interface [A-Z]|implements [A-Z]|@Valid|z\.object\(|BaseModel)"),
    Rule("data_access", r"(?:SELECT |INSERT INTO|UPDATE [A-Za-z_]+ SET|DELETE FROM|\.query\(|\.execute\()"), Rule("documentation", r"(?:/\*\*|\"\"\"|///|@param|@returns?|:param )"),
    Rule("errors", r"(?:catch[ \t]*\(|except[ :]|rescue|throw |raise |panic\(|\.unwrap\()"), Rule("logging", r"(?:log(?:ger)?\.(?:debug|info|warn|error|trace)|console\.(?:log|warn|error)|println!?\(|Log\.)"),
    Rule("performance", r"(?:cache|memo|debounce|throttle|lazy|parallel|async )"), Rule("security", r"(?:eval\(|exec\(|innerHTML|md5|sha1|pickle\.loads|verify=False|password)"),
    Rule("structural", r"(?:^|\n)[ \t]*(?:import|from|use|using|require|package|namespace|module)[ \t]"), Rule("styling", r"(?:className=|style=|styled\.|\.css|tailwind|theme\.)"),
    Rule("testing", r"(?:describe\(|it\(|expect\(|assert|@Test|func Test|#\[test\]|def test_)"), Rule("types", r"(?::[ \t]*(?:string|number|boolean|any|int|str|float|bool)|<T>|TypeVar|as any|unknown)"),
]

#: Extractors of endpoints: the groups are method and path.
ENDPOINTS = [
    Rule("express", r"(?:app|router)\.(get|post|put|patch|delete)\([ \t]*['\"`]([^'\"`\n]+)", ("javascript", "typescript")),
    Rule("fastify", r"fastify\.(get|post|put|patch|delete)\([ \t]*['\"`]([^'\"`\n]+)", ("javascript", "typescript")),
    Rule("nestjs", r"@(Get|Post|Put|Patch|Delete)\([ \t]*['\"`]([^'\"`\n]*)", ("typescript",)),
    Rule("nextjs", r"export[ \t]+(?:async[ \t]+)?function[ \t]+(GET|POST|PUT|PATCH|DELETE)(\()", ("javascript", "typescript")),
    Rule("trpc", r"\.(query|mutation|subscription)(\([ \t]*(?:async)?[ \t]*\()", ("typescript",)),
    Rule("frontend", r"(fetch|axios\.(?:get|post|put|patch|delete))\([ \t]*['\"`]([^'\"`\n]+)", ("javascript", "typescript")),
    Rule("flask", r"@[a-z_]+\.(route|get|post|put|patch|delete)\([ \t]*['\"]([^'\"\n]+)", ("python",)),
    Rule("django", r"[\s\[(,](path|re_path|url)\([ \t]*r?['\"]([^'\"\n]*)", ("python",)),
    Rule("spring", r"@(Get|Post|Put|Patch|Delete|Request)Mapping\([^)\n\"]*\"([^\"\n]+)", ("java", "kotlin")),
    Rule("aspnet", r"\[Http(Get|Post|Put|Patch|Delete)\([ \t]*\"([^\"\n]*)", ("csharp",)),
    Rule("gin", r"\.(GET|POST|PUT|PATCH|DELETE)\([ \t]*\"([^\"\n]+)", ("go",)),
    Rule("actix", r"#\[(get|post|put|patch|delete)\([ \t]*\"([^\"\n]+)", ("rust",)),
    Rule("laravel", r"Route::(get|post|put|patch|delete)\([ \t]*['\"]([^'\"\n]+)", ("php",)),
    Rule("rails", r"(?:^|\n)[ \t]*(get|post|put|patch|delete)[ \t]+['\"]([^'\"\n]+)", ("ruby",)),
]

#: Extractors of stored models: the group is the model's name.
MODELS = [
    Rule("active_record", r"class[ \t]+([A-Za-z_][A-Za-z0-9_]*)[ \t]*<[ \t]*(?:ApplicationRecord|ActiveRecord::Base)", ("ruby",)),
    Rule("django", r"class[ \t]+([A-Za-z_][A-Za-z0-9_]*)\((?:models\.)?Model\)", ("python",)),
    Rule("sqlalchemy", r"class[ \t]+([A-Za-z_][A-Za-z0-9_]*)\((?:db\.Model|Base|DeclarativeBase)\)", ("python",)),
    Rule("ef_core", r"DbSet<([A-Za-z_][A-Za-z0-9_]*)>", ("csharp",)), Rule("hibernate", r"@Entity[^{]*class[ \t]+([A-Za-z_][A-Za-z0-9_]*)", ("java", "kotlin")),
    Rule("eloquent", r"class[ \t]+([A-Za-z_][A-Za-z0-9_]*)[ \t]+extends[ \t]+Model", ("php",)), Rule("mongoose", r"mongoose\.model\([ \t]*['\"]([^'\"\n]+)", ("javascript", "typescript")),
    Rule("prisma", r"prisma\.([A-Za-z_][A-Za-z0-9_]*)\.", ("javascript", "typescript")), Rule("sequelize", r"sequelize\.define\([ \t]*['\"]([^'\"\n]+)", ("javascript", "typescript")),
    Rule("typeorm", r"@Entity\([^)\n]*\)[^{]*class[ \t]+([A-Za-z_][A-Za-z0-9_]*)", ("typescript",)),
]

#: Style genes: gene -> its alleles.
GENES = {
    "animation": {"css": r"@keyframes|animation:", "library": r"framer-motion|gsap|useSpring", "transition": r"transition:"},
    "api_response": {"envelope": r"\{[ \t]*(?:data|result)[ \t]*:", "plain": r"return[ \t]+(?:res|response)\.json\(", "typed": r"ResponseEntity|ActionResult|HttpResponse"},
    "config_pattern": {"environment": r"process\.env|os\.environ|getenv", "file": r"\.(?:ya?ml|toml|json)['\"]", "object": r"[cC]onfig\."},
    "error_response": {"exception": r"throw |raise ", "result": r"Result<|Either|Err\(", "sentinel": r"return[ \t]+(?:null|nil|None|-1)"},
    "logging_format": {"printf": r"log\.[a-z]+\([\"'][^\"'\n]*%[sd]", "structured": r"log\.[a-z]+\([ \t]*\{", "plain": r"console\.log|println|print\("},
    "responsive_approach": {"media": r"@media", "hook": r"useMediaQuery|useBreakpoint", "utility": r"(?:sm|md|lg):[a-z]"},
    "spacing": {"tokens": r"spacing\(|theme\.spacing", "pixels": r"(?:margin|padding):[ \t]*\d+px", "rem": r"(?:margin|padding):[ \t]*[\d.]+rem"},
    "state_styling": {"class": r"classNames?\(|clsx\(", "inline": r"style=\{\{", "attribute": r"data-state="},
    "theming": {"provider": r"ThemeProvider|createTheme", "variables": r"var\(--", "constant": r"COLORS?\."},
    "variant_handling": {"switch": r"switch[ \t]*\(", "map": r"(?:variants?|styles)\[", "conditional": r"\?[^:\n]{1,80}:"},
}

#: Declarative packs as they are read from TOML: all of `all`, one of `any` and none of `none` must stand in a file.
PACKS_TOML = r'''
accessibility = { any = ['aria-', 'role='] }
api = { any = ['router.', '@RestController', 'APIRouter'] }
aspnet = { languages = ['csharp'], any = ['[ApiController]', 'ControllerBase', 'MapGet('] }
auth = { any = ['login(', 'authenticate', 'authorize', 'jwt'], none = ['describe('] }
components = { languages = ['javascript', 'typescript'], any = ['React.', 'useState(', '@Component'] }
config = { any = ['process.env', 'os.environ', 'getenv('] }
data_access = { any = ['SELECT ', 'INSERT INTO', '.query(', '.execute('] }
django = { languages = ['python'], any = ['django', 'models.Model'] }
documentation = { any = ['/**', '"""', '///'] }
errors = { any = ['catch (', 'except', 'throw ', 'raise ', 'panic('] }
express = { languages = ['javascript', 'typescript'], all = ['express'], any = ['app.get(', 'app.use(', 'router.'] }
go_frameworks = { languages = ['go'], any = ['gin.', 'echo.', 'http.HandleFunc'] }
laravel = { languages = ['php'], any = ['Illuminate', 'Route::'] }
logging = { any = ['log.debug', 'log.info', 'log.warn', 'log.error', 'console.log', 'logger.'] }
performance = { any = ['cache', 'memo', 'lazy'], none = ['cache-control'] }
rails = { languages = ['ruby'], any = ['ActiveRecord', 'ApplicationController', 'before_action'] }
rust_frameworks = { languages = ['rust'], any = ['actix', 'axum', 'rocket'] }
security = { any = ['eval(', 'exec(', 'innerHTML', 'md5'] }
spring = { languages = ['java', 'kotlin'], any = ['@Autowired', '@Service', '@RestController'] }
structural = { any = ['import ', 'using ', 'require ', 'use '] }
styling = { any = ['className', 'styled.', 'theme.'] }
testing = { any = ['describe(', 'assert', '@Test', 'def test_'] }
typescript_types = { languages = ['typescript'], any = [': string', ': number', 'interface ', 'as any'], none = ['@ts-nocheck'] }
'''


class Pack(NamedTuple):
    name: str
    languages: tuple[str, ...]
    all: tuple[str, ...]
    any: tuple[str, ...]
    none: tuple[str, ...]


def load_packs(text: str = PACKS_TOML) -> list[Pack]:
    """Packs of a TOML text; a pack without any positive part is refused."""
    packs = [Pack(k, *(tuple(v.get(part, ())) for part in ("languages", "all", "any", "none"))) for k, v in tomllib.loads(text).items()]
    empty = [p.name for p in packs if not p.all and not p.any]
    if empty:
        raise ValueError(f"packs without a positive part: {empty}")
    return packs


def extracted_sql(kind: str) -> str:
    """The SQL of the names of one kind, for a text and a lang."""
    branches = " ".join(f"WHEN lang = '{lang}' THEN regexp_extract_all(text, {quoted(p)}, 1)" for lang, p in SYMBOLS[kind].items())
    return f"CASE {branches} ELSE [] END"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
