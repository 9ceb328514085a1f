"""Fixed schemas and column names of the reports, the spots and the catalogue."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType(), True) for name in names])


# Field names of the spot records.
SPOTS = T.StructType([
    T.StructField("titulo", T.StringType()),
    T.StructField("cautelar", T.BooleanType()),
    T.StructField("folio", T.StringType()),
    T.StructField("ruta", T.BooleanType()),
    T.StructField("es_publico", T.BooleanType()),
    T.StructField("archivoTraduccion", T.StringType()),
    T.StructField("directorio", T.StringType()),
    T.StructField("partido", T.StringType()),
    T.StructField("nombre", T.StringType()),
    T.StructField("transcripcion", T.StringType()),
])

# Header of the Excedentes reports.
EXCEDENTES_COLUMNS = [
    "No.", "ESTADO", "CEVEM", "MEDIO", "SIGLAS", "EMISORA", "MATERIAL", "VERSIÓN", "TIPO ACTOR", "ACTOR",
    "FECHA TRANSMISIÓN", "HORA TRANSMISIÓN", "CALIFICACIÓN", "NOMBRE CONCESIONARIO", "TIPO CONCESIÓN",
    "NOMBRE DE ESTACIÓN", "TIPO MEDIO", "MEDIO (RADIO/TELEVISIÓN)",
]

# Header of the Requerimientos reports.
REQUERIMIENTOS_COLUMNS = [
    "No.", "Entidad", "Organo", "Grupo", "Emisora", "IdEmisora", "Fecha de transmisión del material",
    "Hora transmisión", "Folio", "Versión", "Actor", "Notificado", "Oficio",
]

# Column names of the combined table, in file order.
TRANSMISSIONS_COLUMNS = [
    "No", "ESTADO", "CEVEM", "MEDIO", "SIGLAS", "EMISORA", "MATERIAL", "VERSION", "TIPO_ACTOR", "ACTOR",
    "FECHA_TRANSMISION", "HORA_TRANSMISION", "CALIFICACION", "NOMBRE_CONCESIONARIO", "TIPO_CONCESION",
    "NOMBRE_DE_ESTACIÓN", "TIPO_MEDIO", "MEDIO2", "Organo", "Grupo", "IdEmisora", "Notificado", "Oficio",
    "Fecha de desahogo",
]

# Requerimientos names and the Excedentes names they stand for.
REQUERIMIENTOS_TO_EXCEDENTES = {
    "Entidad": "ESTADO",
    "Emisora": "EMISORA",
    "Versión": "VERSIÓN",
    "Folio": "MATERIAL",
    "Actor": "ACTOR",
    "Fecha de transmisión del material": "FECHA TRANSMISIÓN",
    "Hora transmisión": "HORA TRANSMISIÓN",
}

# The state, date and time columns that identify one airing in both families.
EXCEDENTES_KEYS = ["ESTADO", "FECHA TRANSMISIÓN", "HORA TRANSMISIÓN"]
REQUERIMIENTOS_KEYS = ["Entidad", "Fecha de transmisión del material", "Hora transmisión"]

# Rows above the header line of each report family.
EXCEDENTES_PREAMBLE = 8
REQUERIMIENTOS_PREAMBLE = 11

EXCEDENTES = _strings(EXCEDENTES_COLUMNS)
REQUERIMIENTOS = _strings(REQUERIMIENTOS_COLUMNS)
TRANSMISSIONS = _strings(TRANSMISSIONS_COLUMNS)

CATALOGUE_FOLIO = T.StructType([
    T.StructField("folio", T.StringType()),
    T.StructField("cautelar", T.BooleanType()),
    T.StructField("titulo", T.StringType()),
    T.StructField("ruta", T.BooleanType()),
    T.StructField("es_publico", T.BooleanType()),
    T.StructField("archivoTraduccion", T.StringType()),
])

CATALOGUE_PARTY = T.StructType([
    T.StructField("actor_politico", T.StringType()),
    T.StructField("version", T.ArrayType(T.StringType())),
    T.StructField("folio", T.ArrayType(CATALOGUE_FOLIO)),
])

# One entry per actor and medium; the single map key is `<actor>_<medium>`.
CATALOGUE_ENTRY = T.MapType(T.StringType(), T.ArrayType(CATALOGUE_PARTY))
CATALOGUE = T.ArrayType(CATALOGUE_ENTRY)

ORDER_INDEX = T.StructType([T.StructField("folio", T.StringType()), T.StructField("cautelar", T.BooleanType())])
TRANSCRIPTS = T.StructType([T.StructField("titulo", T.StringType()), T.StructField("transcripcion", T.StringType())])
TRANSCRIPTION_INDEX = T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType())])
LEXICON = T.StructType([T.StructField("token", T.StringType()), T.StructField("valence", T.DoubleType())])
