"""The task texts the web handlers send for one request.

FIXED VALUES: each template is the audited tool's own text, stated as is;
``%s`` marks where the code (and, for fixes, the findings JSON) goes.
"""

ANALYZE_TASK = """El código a analizar está embebido abajo entre ---CODE_START--- y ---CODE_END---.
Escríbelo en un archivo input.go antes de ejecutar cualquier comando.

IMPORTANTE — reglas para el código que generes:
- Embebe el contenido del código como raw string literal en cada programa
- Antes de go build o go vet escribe: os.WriteFile("input.go", []byte(codeContent), 0644)
- En el PASO 3 usa: parser.ParseFile(fset, "input.go", []byte(codeContent), 0)
  pasando los bytes como segundo argumento para leer desde memoria, no desde disco
- NO hardcodees ningún path absoluto — usa solo "input.go"
- Genera programas SIMPLES de máximo 60 líneas cada uno
- Cada programa hace UNA sola cosa

Haz el análisis en este orden, un programa a la vez:

PASO 1: Verifica compilación
Escribe el código en input.go con os.WriteFile, luego ejecuta go build input.go.
Imprime si compila o los errores encontrados.

PASO 2: Ejecuta go vet
Escribe el código en input.go con os.WriteFile, luego ejecuta go vet input.go.
Imprime si hay warnings o "sin problemas".

PASO 3: Mide complejidad
Usa parser.ParseFile(fset, "input.go", []byte(codeContent), 0) con el código embebido
para recorrer las funciones y contar: if, for, range, switch case, &&, ||
Imprime el nombre de cada función y su complejidad.

Cuando termines los 3 pasos, escribe el REPORTE FINAL en texto.

---CODE_START---
%s
---CODE_END---"""

SECURITY_TASK = """El código a analizar está embebido abajo entre ---CODE_START--- y ---CODE_END---.
Escríbelo en un archivo input.go antes de ejecutar cualquier comando.

IMPORTANTE — reglas para el código que generes:
- Embebe el contenido del código como raw string literal en cada programa
- Antes de cualquier análisis escribe: os.WriteFile("input.go", []byte(codeContent), 0644)
- En análisis de AST usa: parser.ParseFile(fset, "input.go", []byte(codeContent), 0)
  pasando los bytes como segundo argumento para leer desde memoria, no desde disco
- NO hardcodees ningún path absoluto — usa solo "input.go"
- Genera programas SIMPLES de máximo 60 líneas cada uno
- Cada programa hace UNA sola cosa

Analiza el código en busca de vulnerabilidades de seguridad en este orden:

PASO 1: Detecta SQL Injection
Usa parser.ParseFile con los bytes del código en memoria para buscar llamadas
a funciones de base de datos con concatenación de strings.
Imprime cada hallazgo con línea y descripción.

PASO 2: Detecta credenciales hardcodeadas
Busca en el AST constantes o strings asignados a variables con nombres como:
password, secret, key, token, apiKey, passwd.
Imprime cada hallazgo con línea y descripción.

PASO 3: Detecta inputs sin sanitizar
Busca entradas de usuario (os.Args, http.Request) que se usen directamente
en operaciones sensibles sin validación previa.
Imprime cada hallazgo con línea y descripción.

OBLIGATORIO AL TERMINAR LOS 3 PASOS:
Primero imprime cada hallazgo como JSON (un objeto por línea).
Luego imprime EXACTAMENTE esta línea sola: ---FINDINGS_END---
Luego escribe el REPORTE FINAL en texto.

---CODE_START---
%s
---CODE_END---"""

FIX_TASK = """Tienes el siguiente código Go con vulnerabilidades confirmadas.
El código está embebido abajo entre ---CODE_START--- y ---CODE_END---.

Vulnerabilidades encontradas:
%s

Para cada vulnerabilidad, genera ÚNICAMENTE el fragmento corregido.
Imprime en este formato exacto por cada fix:
---FIX_START---
ORIGINAL:
<línea original problemática>
FIXED:
<línea o líneas corregidas>
---FIX_END---

---CODE_START---
%s
---CODE_END---"""
