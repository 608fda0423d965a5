"""Small Go inputs of our own, one construct per line where it matters."""

RISKY = """package main

func findLedger(store *Store, branch string) {
\tstmt := "SELECT total FROM ledger WHERE branch=" + branch
\tstore.Query(stmt)
}

func dial() {
\ttoken := "tk-77"
\tsecret = "north-pole"
\topen(token, secret)
}

func serve(r *http.Request) {
\ttool := r.FormValue("tool")
\texec.Command(tool).Run()
}
"""

CALM = """package main

func cool(n int) int {
\tfor n > 9 {
\t\tif n == 13 {
\t\t\tn--
\t\t} else if n == 40 {
\t\t\tn -= 2
\t\t}
\t\tn--
\t}
\treturn n
}

func main() {
\tprintln(cool(30))
}
"""

#: One branch over the limit.
BUSY = "package main\n\nfunc busy(n int) int {\n" + "".join(
    f"\tif n == {i} {{\n\t\tn++\n\t}}\n" for i in range(10)) + "\treturn n\n}\n"
