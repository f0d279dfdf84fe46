"""Column lists and closed vocabularies of the relations."""

# The vocabularies that results are made of.
REASONS = {"syntactic": 1.0, "path-resolved": 1.0, "explicit-mention": 1.0, "receiver-typed": 0.9, "import-scoped": 0.7, "name-match": 0.5}
EDGE_TYPES = ("contains", "imports", "calls", "implements_trait", "extends", "references")
OBJECT_TYPES = ("code_file", "code_module", "code_function", "code_type")
MENTION_KINDS = ("tracking_tag", "requirement_citation", "artifact_reference")
IMPORT_EXTENSIONS = {"rust": ("rs",), "typescript": ("ts", "tsx", "d.ts", "js", "jsx"), "tsx": ("ts", "tsx", "d.ts", "js", "jsx"), "python": ("py", "pyi")}
INDEX_STEMS = {"rust": ("mod",), "typescript": ("index",), "tsx": ("index",), "python": ("__init__",)}
MAX_FILE_BYTES = 8 * 1024 * 1024
MAX_EVIDENCE = 20
MAX_ROUNDS = 10

FILES = "org string, repo string, path string, language string, content string"
EDGE_SITES = "source_ref string, edge_type string, target_ref string, reason string, file string, line int"
EDGES = "source_ref string, edge_type string, target_ref string, confidence double, reason string, evidence array<struct<file:string,line:int>>, count bigint"
NODES = "id string, reference string, object_type string, name string, data struct<kind:string,path:string,span:struct<start:int,end:int>,parent:string,visibility:string,signature:string>"
MENTIONS = "identifier string, kind string, source string, file string, line int"
DIAGNOSTICS = "code string, message string, path string, line int, column int, severity string"
