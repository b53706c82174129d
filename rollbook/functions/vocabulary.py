"""Word lists that drive inference. All of them are small literals inside expressions; nothing is broadcast."""

from __future__ import annotations

# The vocabularies below decide results and must hold exactly these words.

NAME_WORDS = ["nome", "aluno", "aluna", "estudante", "name", "student", "discente", "student name", "full name"]
ID_WORDS = [
    "numero", "num", "n", "no", "id", "codigo", "matricula", "mecanografico", "nmec", "istid", "ist id", "n aluno", "no aluno", "numero aluno",
    "number", "student number", "student id", "reg", "registration",
]

#: Seasons, earliest first.
SEASONS = ["epoca1", "epoca2", "especial"]
#: Strong markers, in the order in which they are tried.
STRONG_SEASON = [
    ("especial", ["epoca especial", "especial", "ep especial", "3 epoca", "3a epoca", "terceira epoca", "ee", "special season", "special sitting", "special period", "3rd season"]),
    ("epoca2", ["2 epoca", "2a epoca", "segunda epoca", "epoca 2", "recurso", "repescagem", "ep2", "2e", "epoca de recurso", "2nd season", "second season", "resit", "resit season", "2nd sitting", "supplementary", "season 2"]),
    ("epoca1", ["1 epoca", "1a epoca", "primeira epoca", "epoca 1", "epoca normal", "normal", "ep1", "1e", "epoca de exames", "1st season", "first season", "normal season", "1st sitting", "season 1", "regular season"]),
]
WEAK_SEASON = [("epoca1", ["teste 1", "exame 1", "prova 1", "frequencia 1", "1 teste", "1 exame", "1 prova", "t1", "e1"])]
MOMENT_WORDS = ["teste", "exame", "prova", "frequencia", "nota", "final", "avaliacao", "classificacao", "class", "nf", "cf", "epoca"]
EXAM_WORDS = ["exame", "recurso", "prova"]
CONTINUOUS_WORDS = ["teste", "frequencia", "continua", "mini", "projeto", "projecto", "trabalho", "participacao"]

FINAL_WORDS = [
    "avaliacao final", "classificacao final", "nota final", "class final", "final", "nota", "classificacao", "avaliacao", "total", "media",
    "resultado", "pauta", "cf", "nf", "final grade", "final mark", "overall grade", "grade", "mark", "marks", "result", "overall", "average", "final result",
]
FINAL_PRIORITY = {
    "avaliacao final": 100, "classificacao final": 95, "class final": 95, "nota final": 90, "classificacao": 70, "avaliacao": 68, "nota": 65,
    "final": 60, "resultado": 55, "media": 45, "total": 40, "cf": 85, "nf": 85, "final grade": 100, "final mark": 98, "overall grade": 95,
    "final result": 95, "grade": 88, "mark": 80, "marks": 80, "overall": 70, "result": 62, "average": 45,
}
COMPONENT_WORDS = [
    "projeto", "projecto", "trabalho", "participacao", "presenca", "lab", "laboratorio", "exercicio", "ex", "quiz", "mini", "questao", "pergunta",
    "parte", "grupo", "relatorio", "defesa", "apresentacao", "frequencia", "teorica", "pratica", "tpc", "bonus", "moodle", "teste", "exame", "prova",
    "test", "exam", "labs", "laboratory", "laboratories", "assignment", "homework", "attendance", "participation", "max", "midterm",
    "project", "report", "presentation", "coursework", "practical", "theory",
]
IGNORE_WORDS = [
    "obs", "observacoes", "notas obs", "comentario", "email", "turma", "curso", "ects", "estado", "situacao", "assinatura", "rubrica",
    "date", "data", "comments", "remarks", "signature", "class", "group", "status", "programme", "course", "year",
]
FOOTER_WORDS = ["total", "media", "resumo", "aprovados", "reprovados", "docente", "assinatura", "obs", "observacoes"]

#: Words that no subject's name holds; words that say nothing about one.
NOT_A_SUBJECT = [
    "university", "universidade", "institute", "instituto", "faculty", "faculdade", "escola", "school", "politecnico", "department",
    "departamento", "lisbon", "lisboa", "porto", "coimbra", "iscte", "ist", "failure", "failed", "withdrawal", "assessed", "minimum", "passing",
    "attained", "nonattendance", "reprovado", "aprovado", "faltou", "desistiu", "semester", "semestre", "season", "epoca", "sitting", "period", "periodo",
    "pauta", "marks", "assessment", "avaliacao", "review", "total", "notas", "classificacoes", "exam", "exame", "office", "sala",
]
SUBJECT_STOP_WORDS = [
    "de", "da", "do", "das", "dos", "e", "a", "o", "as", "os", "em", "primeira", "segunda", "terceira", "especial", "normal", "recurso",
    "aluno", "alunos", "students", "student", "folha", "sheet", "geral", "dados", "copia", "copy", "sem", "titulo", "novo", "nova", "ficheiro",
    "numero", "numeros", "com", "sheet1", "folha1", "tabela", "turma",
]
NAME_PARTICLES = ["de", "da", "do", "das", "dos", "e", "del", "la", "van", "von", "y"]

#: Statuses, best first.
STATUSES = ["APROVADO", "REPROVADO", "FALTOU", "DESISTIU", "NAO_ADMITIDO", "SEM_NOTA"]
NO_GRADE = "SEM_NOTA"
FAILING = ["REPROVADO", "FALTOU", "DESISTIU", "NAO_ADMITIDO"]
#: What a cell may say, in the order in which prefixes are tried.
STATUS_WORDS = {
    "re": "REPROVADO", "rep": "REPROVADO", "repr": "REPROVADO", "reprovado": "REPROVADO", "reprovada": "REPROVADO", "nao aprovado": "REPROVADO", "insuficiente": "REPROVADO",
    "ap": "APROVADO", "apr": "APROVADO", "aprovado": "APROVADO", "aprovada": "APROVADO",
    "na": "NAO_ADMITIDO", "n a": "NAO_ADMITIDO", "nadm": "NAO_ADMITIDO", "nao admitido": "NAO_ADMITIDO", "nao admitida": "NAO_ADMITIDO", "nao avaliado": "NAO_ADMITIDO", "sem frequencia": "NAO_ADMITIDO", "excluido": "NAO_ADMITIDO",
    "fa": "FALTOU", "falta": "FALTOU", "faltou": "FALTOU", "f": "FALTOU", "ausente": "FALTOU", "aus": "FALTOU", "nc": "FALTOU", "nao compareceu": "FALTOU",
    "des": "DESISTIU", "desistiu": "DESISTIU", "desistente": "DESISTIU", "anulada": "DESISTIU", "anulado": "DESISTIU", "d": "DESISTIU", "withdrawal": "DESISTIU", "withdrawn": "DESISTIU",
    "m": "REPROVADO", "failed": "REPROVADO", "fail": "REPROVADO", "not assessed": "NAO_ADMITIDO", "absent": "FALTOU", "passed": "APROVADO", "pass": "APROVADO",
}
EMPTY_WORDS = ["", "-", "--", "---", "n/d", "nd", "s/n", "sn", ".", "/", "x"]
# End of fixed values.
