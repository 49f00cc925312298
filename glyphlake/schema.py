"""Schemas of the engine's relations; every reader and operator states its own instead of inferring one."""

FILES = "file_id long, path string, ext string, text string"
SYMBOLS = "name string, kind string, module string, path string, annotation string, imported_name string, src int, pos int"
#: Order in which declarations of one name win: attributes, functions, classes, from-imports, names only listed.
SOURCES = ("attribute", "function", "class", "import", "listed")
METHODS = "class_name string, method string, return_kind string, return_elems array<string>"
BASES = "class_name string, base string"
SETTINGS = "execution_mode string, executable string, wsl_distribution string, docker_image string, docker_dir string, docker_command string, parameters string"
RUNS = "name string, script_path string, script_parameters string"
TEMPLATES = "key string, body string, conditions array<string>, topmost boolean, builtin boolean"
