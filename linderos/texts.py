"""Rule texts: what a violation row says.

Fixed values.  Severity, description, message variants and expected-value text
of every rule must read exactly like this, because consumers of the violations
table filter and group on them.  Rules that differ only in a parameter are built
from that parameter.
"""

from __future__ import annotations

from typing import NamedTuple

E, A = "error", "advertencia"


class Text(NamedTuple):
    severidad: str
    descripcion: str
    mensajes: tuple[str, ...] = ()
    esperado: str = ""

    @property
    def mensaje(self) -> str:
        return self.mensajes[0]


TEXTS: dict[str, Text] = {}

# ---------------------------------------------------------------- fixed values
# Parcel number: positions 22-30 per condition.
# rule -> (required suffix, label in the description, label in the message)
SUFFIXES = {
    "R-01": ("000000000", "condición NPH", "NPH"),
    "R-02": ("300000000", "Bien_Uso_Publico", "Bien de Uso Público"),
    "R-03": ("400000000", "Vía", "Vía"),
    "R-04": ("700000000", "Parque Cementerio", "Parque Cementerio"),
    "R-05": ("200000000", "Informal", "Informal"),
    "R-10": ("900000000", "PH.Matriz", "PH.Matriz"),
    "R-12": ("800000000", "Condominio.Matriz", "Condominio.Matriz"),
}
for _id, (_suffix, _in_description, _in_message) in SUFFIXES.items():
    TEXTS[_id] = Text(
        E,
        f"Posiciones 22-30 deben ser '{_suffix}' para {_in_description}",
        (f"Posiciones 22-30 deben ser {_suffix} para {_in_message}",),
        _suffix,
    )

TEXTS |= {
    "R-08-A": Text(E, "numero_predial debe tener 30 dígitos en cca_predio",
                   ("numero_predial_nacional debe tener exactamente 30 caracteres",), "30"),
    "R-08-B": Text(E, "numero_predial debe tener 30 dígitos en cca_estructuranovedadnumeropredial",
                   ("numero_predial debe tener exactamente 30 caracteres",), "30"),
    "R-09": Text(E, "Posiciones 14-17 y 18-21 del número predial no pueden ser '0000'",
                 ("Posiciones 14-17 y 18-21 son 0000", "Posiciones 14-17 son 0000", "Posiciones 18-21 son 0000"),
                 "<>0000 / <>0000"),
    "R-11": Text(E, "PH.Unidad_Predial: pos 22='9', pos 23-24<>'00', pos 25-26<>'00', pos 27-30<>'0000'",
                 ("Patrón inválido en posiciones 22-30 para PH.Unidad_Predial",),
                 "9 + (23-24<>00) + (25-26<>00) + (27-30<>0000)"),
    "R-13": Text(E, "Condominio.Unidad_Predial: pos 22-26='80000' y pos 27-30<>'0000'",
                 ("Patrón inválido en posiciones 22-30 para Condominio.Unidad_Predial",), "80000 + (27-30<>0000)"),
    "R-14": Text(E, "Posición 22 del número predial no debe ser '1', '5' ni '6'",
                 ("Posición 22 contiene un valor prohibido (1, 5 o 6)",), "no ser 1, 5, 6"),
    # coherencia_geografica: the text always names the default department / municipality
    "R-15": Text(E, "Posiciones 1-2 del número predial deben corresponder al Departamento",
                 ("Posiciones 1-2 no corresponden al Departamento 25",)),
    "R-16": Text(E, "Posiciones 3-5 del número predial deben corresponder al Municipio",
                 ("Posiciones 3-5 no corresponden al Municipio 506",)),
    # duplicados
    "R-17": Text(E, "Los registros de número predial no deben tener duplicados",
                 ("numero_predial_nacional duplicado",), "único"),
    "R-18": Text(A, "folio_matricula no debe estar asociado a más de un número predial",
                 ("folio_matricula compartido por varios predios",), "único o justificar excepción"),
    # registral
    "R-24-A": Text(E, "Si Codigo_ORIP y Matricula_Inmobiliaria no están diligenciados, Area_Registral_M2 debe ser cero",
                   ("Sin ORIP ni Matrícula pero con área registral > 0",), "area_registral_m2 = 0"),
    "R-24-B": Text(E, "Si Area_Registral_M2 > 0, los campos Codigo_ORIP y Matricula_Inmobiliaria deben estar diligenciados",
                   ("Área registral > 0 pero falta ORIP y/o Matrícula",), "orip y matrícula diligenciados"),
    # destinacion_uso
    "R-21": Text(E, "Predios con destinación Lote_Urbanizado_No_Construido no deben tener unidades de construcción asociadas",
                 ("Lote_Urbanizado_No_Construido con ", " unidad(es) de construcción asociada(s)"), "0"),
    "R-23": Text(E, "Predios con destinación Comercial, Educativo, Habitacional, Industrial, Institucional o Salubridad "
                    "deben tener al menos una unidad de construcción asociada",
                 ("Destinación que exige unidad de construcción no tiene ninguna asociada",), ">=1"),
    # terreno
    "R-25-A": Text(E, "Cada predio con condición NPH/PH.Matriz/Condominio.*/Via/Bien_Uso_Publico/Parque_Cementerio.Matriz "
                      "debe tener exactamente un cca_terreno asociado (excepto si tiene novedad de cancelación)",
                   ("Predio sin cca_terreno asociado", "Predio con ", " terrenos asociados"), "1"),
    "R-25-B": Text(E, "Todo cca_terreno debe estar asociado a un cca_predio con condición admisible y sin novedad de cancelación",
                   ("Terreno sin cca_predio asociado", "Terreno asociado a predio con condición no admisible: ",
                    "Terreno asociado a predio con novedad de cancelación"),
                   "predio con condición admisible y sin cancelación"),
    # ph_condominio
    "R-26": Text(E, "La sumatoria de coeficiente_copropiedad de las unidades prediales asociadas a una matriz "
                    "PH/Condominio debe ser 1", ("Suma de coeficientes de unidades = ",), "1.0"),
    "R-27": Text(A, "La sumatoria de area_coeficiente de las unidades prediales debe igualar el área de terreno del predio matriz",
                 ("Suma area_coeficiente vs área terreno matriz fuera de tolerancia",)),
    "R-28": Text(E, "Solo los predios PH.Matriz o Condominio.Matriz deben tener diligenciados los campos PH/Condo "
                    "(área totales, num. torres, etc.); en los demás esos campos deben estar nulos",
                 ("Predio no-matriz con campos PH/Condo diligenciados",), "todos NULL"),
    "R-29": Text(E, "Una matriz PH/Condominio no puede tener una sola unidad predial asociada",
                 ("Matriz PH/Condominio con solo 1 unidad asociada",), ">=2"),
    "R-30": Text(E, "Una unidad PH/Condominio debe tener un predio matriz existente y con condición coherente",
                 ("Unidad sin numero_predial_matriz diligenciado", "numero_predial_matriz no existe en cca_predio",
                  "numero_predial_matriz existe pero su condicion_predio no es matriz coherente")),
    "R-31-A": Text(A, "PH.Matriz: area_total_terreno debe corresponder al área geográfica del predio matriz",
                   ("area_total_terreno difiere del área geográfica del matriz",)),
    "R-31-C": Text(E, "PH.Matriz: area_total_terreno_privada debe ser 0",
                   ("area_total_terreno_privada debe ser 0 en PH.Matriz",), "0"),
    "R-32": Text(A, "PH.Matriz: area_total_construida = suma de áreas de unidades de construcción de las unidades + del propio matriz",
                 ("area_total_construida difiere de la suma de UCs (privadas + matriz)",)),
    "R-33": Text(A, "PH.Matriz: area_total_construida_privada = suma de áreas de unidades de construcción asociadas a las unidades prediales",
                 ("area_total_construida_privada difiere de la suma de UCs de unidades",)),
    "R-34": Text(A, "PH.Matriz: area_total_construida_comun = suma de áreas de UCs del propio predio matriz",
                 ("area_total_construida_comun difiere de la suma de UCs del matriz",)),
    "R-35": Text(E, "PH.Matriz: numero_torres = MAX(posiciones 25-26 del número predial de las unidades asociadas)",
                 ("numero_torres no coincide con el máximo de las posiciones 25-26 de las unidades",)),
    "R-36": Text(E, "PH.Matriz: total_unidades_privadas = conteo de unidades asociadas",
                 ("total_unidades_privadas no coincide con el conteo real de unidades",)),
    "R-37": Text(A, "Condominio.Matriz: area_total_terreno = suma del área geográfica del terreno del matriz + "
                    "áreas geográficas de los terrenos de las unidades",
                 ("area_total_terreno difiere de (terreno matriz + terrenos unidades)",)),
    "R-38": Text(A, "Condominio.Matriz: area_total_terreno_privada = suma de áreas geográficas de los terrenos de las unidades privadas",
                 ("area_total_terreno_privada difiere de la suma de terrenos de unidades",)),
    "R-40": Text(A, "Condominio.Matriz: area_total_construida = suma de UCs asociadas a las unidades prediales + al predio matriz",
                 ("area_total_construida difiere de la suma de UCs (unidades + matriz)",)),
    "R-41": Text(A, "Condominio.Matriz: area_total_construida_privada = suma de UCs asociadas a las unidades prediales",
                 ("area_total_construida_privada difiere de la suma de UCs de unidades",)),
    "R-42": Text(A, "Condominio.Matriz: area_total_construida_comun = suma de UCs asociadas al propio Condominio.Matriz",
                 ("area_total_construida_comun difiere de la suma de UCs del matriz",)),
    "R-43": Text(E, "Condominio.Matriz: numero_torres debe ser 0", ("numero_torres debe ser 0 en Condominio.Matriz",), "0"),
    "R-44": Text(E, "Condominio.Matriz: total_unidades_privadas = conteo de unidades asociadas",
                 ("total_unidades_privadas no coincide con el conteo real de unidades",)),
    # fisicas
    "RF-01": Text(A, "PH Unidad Predial debe tener unidad de construcción asociada (excepto parqueaderos/garajes "
                     "descubiertos o unidades no construidas)",
                  ("PH Unidad Predial sin unidad de construcción asociada",), ">=1 UC"),
    "RF-02": Text(E, "Unidades en PH/Condominio deben relacionar usos específicos de PH o Depositos_Lockers",
                  ("UC en PH/Condominio con uso no específico de PH",), "uso PH o Depositos_Lockers"),
    "RF-03": Text(E, "Unidades en predios sin condición PH/Condominio no deben relacionar usos de PH",
                  ("UC en predio no-PH/Condo con uso específico de PH",), "uso no-PH"),
    "RF-04": Text(E, "Cada unidad de construcción debe estar relacionada con un solo predio",
                  ("UC sin predio asociado", "UC asociada a predio inexistente"), "predio válido"),
    "RF-05": Text(A, "No deben existir polígonos de terreno menores a 2 m² (aplican excepciones)",
                  ("Terreno con área menor a 2 m²",), ">= 2 m²"),
    "RF-06": Text(E, "El identificador de UC debe ser único por predio y debe iniciar en 'A' con continuidad alfabética",
                  ("Primer identificador de UC no es A",), "A"),
}

# Construction type -> allowed use codes.  rule -> (type code, label, first use, last use)
USE_DOMAINS = {
    "RF-07": ("4", "Anexo", 67, 101),
    "RF-08": ("1", "Comercial", 15, 38),
    "RF-09": ("2", "Industrial", 39, 43),
    "RF-10": ("3", "Institucional", 44, 66),
    "RF-11": ("0", "Residencial", 0, 14),
}
for _id, (_type, _label, _first, _last) in USE_DOMAINS.items():
    TEXTS[_id] = Text(E, f"UC tipo {_label} solo debe asociar usos del dominio {_label}",
                      (f"UC tipo {_label} con uso no-{_label}",), f"uso {_label} ({_first}-{_last})")

TEXTS["RF-12"] = Text(E, "La planta de ubicación de la UC no puede ser cero ni negativa",
                      ("planta_ubicacion es 0 o negativa",), "> 0")

# Dominant construction type per land use.
# rule -> (land-use codes, type code, type label, parcel label, name in the found value)
DOMINANT_TYPES = {
    "RF-13": (("9",), "0", "Residencial", "Habitacional", "resid"),
    "RF-14": (("5",), "1", "Comercial", "Comercial", "comerc"),
    "RF-15": (("10",), "2", "Industrial", "Industrial", "indust"),
    "RF-16": (("7", "16", "23"), "3", "Institucional", "Institucional/Educativo/Religioso", "instit"),
}
_DOMINANT_DESCRIPTIONS = {
    "RF-13": "Predios con destinación Habitacional deben tener al menos una UC Residencial predominante en área construida",
    "RF-14": "Predios con destinación Comercial deben tener al menos una UC Comercial predominante en área construida",
    "RF-15": "Predios con destinación Industrial deben tener al menos una UC Industrial predominante en área construida",
    "RF-16": "Predios con destinación Institucional, Educativo o Religioso deben tener al menos una UC Institucional predominante",
}
for _id, (_uses, _type, _label, _parcel, _name) in DOMINANT_TYPES.items():
    TEXTS[_id] = Text(A, _DOMINANT_DESCRIPTIONS[_id],
                      (f"Predio {_parcel} sin UC {_label}", f"UC {_label} no predominante en área"),
                      f"UC {_label} predominante")

TEXTS |= {
    "RF-17": Text(E, "total_plantas de la UC debe estar diligenciada y ser mayor a cero",
                  ("total_plantas es NULL, 0 o negativo",), "> 0"),
    "RF-18": Text(E, "Para PH/Condominio Unidad Predial: area_construida debe ser 0 y area_privada_construida debe ser mayor a 0",
                  ("area_construida debe ser 0 en PH/Condo Unidad", "area_privada_construida debe ser > 0 en PH/Condo Unidad"),
                  "area_construida=0, area_privada_construida>0"),
    "RF-19": Text(E, "Para predios no PH/Condominio Unidad: area_construida debe ser > 0 y area_privada_construida debe ser NULL",
                  ("area_construida debe ser > 0 para no-PH/Condo", "area_privada_construida debe ser NULL para no-PH/Condo"),
                  "area_construida>0, area_privada_construida=NULL"),
    "RF-20": Text(A, "El area_construida diligenciada debe coincidir con el área calculada del polígono de la UC (requiere SpatiaLite)",
                  ("area_construida difiere del área geográfica del polígono UC",)),
    "RF-21": Text(A, "La suma de áreas de polígonos por identificador debe coincidir con area_construida "
                     "(o area_privada_construida en PH/Condo)",
                  ("Suma polígonos UC (", ") difiere del área declarada")),
    # juridicas
    "RJ-01": Text(E, "La fecha de inicio de tenencia del derecho debe ser mayor a cero y menor a la fecha de visita al predio",
                  ("Fecha inicio de tenencia vacía", "Fecha inicio de tenencia >= fecha de visita"), "entre 0 y "),
    "RJ-02-A": Text(E, "Predio formal privado con Derecho de Dominio debe tener Matrícula Inmobiliaria",
                    ("Predio privado formal con Dominio sin matrícula inmobiliaria",), "folio_matricula diligenciado"),
    "RJ-02-B": Text(A, "Predio informal con Posesión u Ocupación no debe tener Matrícula Inmobiliaria (aplican excepciones)",
                    ("Predio informal con Posesión/Ocupación tiene matrícula inmobiliaria",), "sin matrícula"),
    "RJ-03": Text(E, "Predios con derecho de Posesión deben ser tipo de predio Privado",
                  ("Predio con Posesión pero tipo_predio no es Privado",), "4 (Privado)"),
    "RJ-04": Text(E, "Predios con tipo Privado no deben tener derecho de Ocupación",
                  ("Predio Privado con derecho de Ocupación",), "tipo_derecho <> 1 (Ocupación)"),
    "RJ-05": Text(E, "Predios de tipo público no pueden tener derecho de Posesión",
                  ("Predio público con derecho de Posesión",), "tipo_derecho <> 2 (Posesión)"),
    "RJ-06": Text(E, "En predios baldíos con Dominio, el interesado debe ser la Nación, Municipio o Agencia Nacional de Tierras",
                  ("Predio baldío con Dominio: interesado no es Nación/Municipio/ANT",),
                  "Nación / Municipio / Agencia Nacional de Tierras"),
    "RJ-07": Text(A, "Si el predio es Privado colectivo (agrupación étnica), el interesado debe tener grupo_etnico "
                     "diligenciado y distinto de Ninguno",
                  ("Interesado en agrupación étnica sin grupo_etnico válido",), "grupo_etnico diligenciado y <> 6 (Ninguno)"),
    "RJ-08": Text(E, "En predios presuntos baldíos con Ocupación, el interesado NO debe ser la Nación, Municipio o "
                     "Agencia Nacional de Tierras",
                  ("Predio presunto baldío con Ocupación: interesado es entidad pública",
                   "Predio presunto baldío con Ocupación: interesado en agrupación es entidad pública"),
                  "interesado diferente a Nación/Municipio/ANT"),
    "RJ-09": Text(E, "Predios públicos (fiscales/patrimoniales o de uso público) con Dominio: el interesado debe ser Persona Jurídica",
                  ("Predio público con Dominio: interesado no es Persona Jurídica",), "1 (Persona_Juridica)"),
    "RJ-10": Text(E, "Predios de vía o uso público deben tener tipo_predio Uso_Publico y tipo de derecho Dominio",
                  ("tipo_predio debe ser 2 (Uso_Publico)", "tipo_derecho debe ser 0 (Dominio)"), "tipo_predio=2, tipo_derecho=0"),
    "RJ-11": Text(E, "Para predios con FMI, la fecha de inicio de tenencia debe ser >= la fecha del documento fuente (título)",
                  ("fecha_inicio_derecho anterior a fecha del documento fuente",)),
    "RJ-12-A": Text(E, "Si el predio tiene FMI, debe tener fuente administrativa con fecha, tipo, número y ente emisor diligenciados",
                    ("Derecho sin fuente administrativa asociada", "Fuente sin fecha_fuente", "Fuente sin tipo_fuente",
                     "Fuente sin nombre_fuente (número)", "Fuente sin ente_emisor"), "todos diligenciados"),
    "RJ-12-B": Text(E, "La fecha del documento fuente no puede ser posterior a la fecha de levantamiento (visita al predio)",
                    ("Fecha del documento fuente posterior a la fecha de visita",)),
    "RJ-13": Text(E, "Persona Jurídica solo debe tener tipo de documento NIT o Secuencial",
                  ("Persona Jurídica con tipo_documento no válido",), "2 (NIT) o 6 (Secuencial)"),
    "RJ-14": Text(E, "Persona Natural solo debe tener tipo de documento CC, CE, Pasaporte, RC, TI o Secuencial",
                  ("Persona Natural con tipo_documento no válido",), "0(CC), 1(CE), 3(Pasaporte), 4(RC), 5(TI) o 6(Secuencial)"),
    "RJ-15": Text(E, "Si el tipo de documento es CC, CE, TI o RC, el número de documento no debe ser cero ni vacío",
                  ("Documento tipo ", " con número vacío o cero"), "número válido > 0"),
    "RJ-16": Text(E, "Si el tipo de documento es NIT, el número debe ser numérico con guion y dígito de verificación, "
                     "sin ser consecutivo (ej: 12345678-9)",
                  ("NIT vacío", "NIT sin guion separador"), "formato: 99999999-9"),
    "RJ-17": Text(E, "nombre_interesado de Persona Natural no debe contener números ni caracteres especiales",
                  ("nombre_interesado contiene números o caracteres especiales",), "solo letras, espacios y guiones"),
    "RJ-18": Text(E, "Persona Jurídica no debe usar nombre_interesado; debe usar razon_social",
                  ("Persona Jurídica con nombre_interesado diligenciado",), "nombre_interesado vacío o NULL"),
    "RJ-19": Text(A, "nombre_interesado de Persona Natural no debe contener referencias a sucesiones ilíquidas (SUC)",
                  ("nombre_interesado contiene referencia a sucesión (SUC)",), "sin referencias a sucesiones en el nombre"),
    "RJ-20": Text(E, "razon_social solo debe estar diligenciada para Persona Jurídica",
                  ("Persona Natural con razon_social diligenciada",), "razon_social vacía o NULL para Persona Natural"),
    "RJ-21": Text(E, "El atributo sexo solo debe usarse para Persona Natural",
                  ("Persona Jurídica con campo sexo diligenciado",), "sexo NULL para Persona Jurídica"),
    "RJ-22": Text(E, "Persona Natural no debe asociar razón social en lugar de nombre de persona",
                  ("Persona Natural sin nombre_interesado pero con razon_social",), "nombre_interesado diligenciado"),
    "RJ-23": Text(E, "Si la agrupación tiene Personas Naturales y Jurídicas, el tipo de agrupación debe ser Grupo_Mixto",
                  ("Agrupación mixta (naturales + jurídicas) con tipo incorrecto",), "3 (Grupo_Mixto)"),
    "RJ-24": Text(E, "Si la agrupación solo tiene Personas Naturales, el tipo de agrupación debe ser Grupo_Civil",
                  ("Agrupación solo de Personas Naturales con tipo incorrecto",), "0 (Grupo_Civil)"),
    "RJ-25": Text(E, "Si la agrupación solo tiene Personas Jurídicas, el tipo de agrupación debe ser Grupo_Empresarial",
                  ("Agrupación solo de Personas Jurídicas con tipo incorrecto",), "1 (Grupo_Empresarial)"),
    "RJ-26": Text(A, "La suma del porcentaje de participación de la agrupación debe ser coherente (1 si FMI detalla "
                     "porcentaje, 0/NULL en caso contrario)",
                  ("porcentaje_participacion diligenciado pero <> 0 y <> 1",), "0 o 1"),
    "RJ-27": Text(E, "El registro de ente emisor, número de fuente y fecha de documento debe ser congruente con el tipo de fuente",
                  ("tipo_fuente es Sin_Documento pero tiene datos diligenciados",
                   "tipo_fuente requiere ente_emisor/nombre_fuente/fecha_fuente completos"),
                  "datos congruentes con tipo de fuente"),
    "RJ-28": Text(A, "El ente emisor debe corresponder al tipo de fuente administrativa (ej: Escritura Publica - Notaria)",
                  ("ente_emisor no parece corresponder al tipo_fuente",)),
    "RJ-29": Text(E, "Todo predio debe tener asociado un interesado o agrupación de interesados a través de un derecho",
                  ("Predio sin derecho asociado", "Derecho sin interesado ni agrupación"), "al menos un interesado o agrupación"),
    "RJ-30": Text(A, "Interesados con igual nombre/razón social pero diferente número de documento deben verificarse (posibles homónimos)",
                  ("Posible homónimo: mismo nombre, diferente documento",), "verificar si son personas distintas"),
    "RJ-31": Text(E, "No deben existir dos interesados con el mismo número de documento",
                  ("numero_documento duplicado",), "único"),
    # novedades
    "RN-01": Text(E, "Los predios asociados al desenglobe deben tener folio de matrícula",
                  ("Predio con desenglobe sin folio de matrícula",), "folio_matricula diligenciado"),
    "RN-02": Text(E, "El número predial en estructura novedad de desenglobe debe existir en el R1 (insumo inicial o periódico)",
                  ("NP de desenglobe no existe en R1",), "existir en R1"),
    "RN-03": Text(E, "El número predial de la novedad de desenglobe y el número predial del predio no deben ser predios informales",
                  ("Predio informal asociado a desenglobe",), "no informal (condicion <> 9)"),
    "RN-04": Text(A, "Desenglobe por venta parcial: un registro debe mantener el mismo NP y los restantes deben ser "
                     "predios nuevos con desenglobe",
                  ("Desenglobe venta parcial: no hay exactamente 1 registro con mismo NP",), "exactamente 1 registro con mismo NP"),
    "RN-05": Text(A, "Desenglobe por división material: un registro con mismo NP debe ser cancelación y los restantes "
                     "deben ser desenglobe división material",
                  ("División material: estructura de novedades inconsistente",),
                  "1 cancelación con mismo NP + resto desenglobe div. material"),
    "RN-06": Text(E, "Los predios asociados al englobe deben tener folio de matrícula",
                  ("Predio con englobe sin folio de matrícula",), "folio_matricula diligenciado"),
    "RN-07": Text(E, "El número predial en estructura novedad de englobe debe existir en el R1",
                  ("NP de englobe no existe en R1",), "existir en R1"),
    "RN-08": Text(A, "Englobe mantiene FMI: al menos 3 registros, todos con novedad Englobe_Mantiene_FMI, y los que no "
                     "mantienen NP deben tener cancelación por englobe",
                  ("Englobe mantiene FMI: estructura inconsistente",), "al menos 3 registros con estructura válida"),
    "RN-09": Text(A, "Englobe nuevo FMI: al menos 4 registros; todos los predios englobados deben tener Englobe_Nuevo_FMI "
                     "y Cancelación por englobe; NP resultante posición 18 debe ser 9 o A-Z",
                  ("Englobe nuevo FMI: estructura inconsistente",), "al menos 4 registros con estructura válida"),
    "RN-10": Text(E, "El número predial del predio que se cancela no debe ser predio nuevo",
                  ("Predio cancelado es también predio nuevo",), "cancelación no aplica a predios nuevos"),
    "RN-11": Text(E, "El número predial del predio que se cancela no debe ser predio informal",
                  ("Predio informal con novedad de cancelación",), "no informal"),
    "RN-12": Text(E, "En cancelación, el número predial debe ser el mismo en cca_predio y en cca_estructuranovedadnumeropredial",
                  ("NP en estructura novedad difiere del NP en cca_predio",), "deben ser iguales"),
    "RN-13": Text(E, "Los predios cancelados deben tener observación que especifique el motivo de la cancelación",
                  ("Cancelación sin observación en el derecho del predio",), "observación con motivo de cancelación"),
    "RN-14": Text(E, "Los predios cancelados no deben tener información espacial (terreno ni unidades de construcción)",
                  ("Predio cancelado con terreno asociado", "Predio cancelado con UC asociada"), "sin terreno ni UC"),
    "RN-15": Text(E, "En cambio de NP, el número predial en estructura novedad debe ser diferente al de cca_predio, y el "
                     "NP antiguo no debe existir en cca_predio",
                  ("Cambio de NP: NP en estructura = NP en predio (deben diferir)",
                   "NP antiguo de cambio existe como NP de otro predio"),
                  "NP estructura <> NP predio, y NP antiguo no en cca_predio"),
    "RN-16": Text(E, "En cambio de NP, el número predial en estructura no debe ser predio nuevo ni informal",
                  ("NP de cambio es predio nuevo o informal en R1 / estructura",), "NP no nuevo ni informal"),
    "RN-17": Text(E, "En cambio de NP, el NP resultante en cca_predio no debe existir en el R1 y debe ser predio nuevo",
                  ("NP resultante de cambio existe en R1 (no debería)",), "no existir en R1"),
    "RN-18": Text(E, "En predio nuevo, el NP en estructura novedad debe ser igual al NP en cca_predio",
                  ("Predio nuevo: NP en estructura <> NP en predio",), "deben ser iguales"),
    "RN-19": Text(E, "En predio nuevo, tanto el NP de estructura como el de cca_predio deben ser predios nuevos (no existir en R1)",
                  ("Predio nuevo pero NP existe en R1",), "no existir en R1"),
    "RN-20": Text(E, "En predio nuevo, el NP no debe existir en el R1 de insumo",
                  ("NP de predio nuevo existe en R1",), "no existir en R1"),
    "RN-21": Text(E, "El NP en estructura novedad de predio nuevo no puede ser mejora (condicion_predio = 5)",
                  ("Predio nuevo es mejora (condicion=5)",), "condicion <> 5 (Mejora)"),
    "RN-22": Text(E, "Todos los predios del R1 deben estar en la tabla de estructura de novedad",
                  ("Predio del R1 no tiene novedad registrada",), "existir en estructura novedad"),
    "RN-23": Text(E, "Un número predial no puede relacionar más de una vez una novedad de cambio de número predial",
                  ("NP con más de un cambio de número predial",), "1"),
    "RN-24-A": Text(E, "Un número predial no puede relacionar simultáneamente una novedad de englobe y una de desenglobe",
                    ("NP con englobe y desenglobe simultáneamente",), "solo englobe o solo desenglobe"),
    "RN-24-B": Text(E, "Un número predial no puede tener novedades y números prediales repetidos en estructura novedad",
                    ("NP con novedad duplicada (mismo tipo_novedad y NP)",), "combinación NP + tipo_novedad única"),
    "RN-25": Text(E, "A un número predial no se le puede relacionar simultáneamente una novedad de Cancelación y una de Predio Nuevo",
                  ("NP con Cancelación y Predio Nuevo simultáneamente",), "solo cancelación o solo predio nuevo"),
    "RN-26": Text(E, "Todas las mejoras registradas en el R1 deben asociar una novedad de Cambio de Número Predial o Cancelación",
                  ("Mejora sin novedad de cambio de NP ni cancelación",), "cambio de NP o cancelación"),
}
# ------------------------------------------------------------ end fixed values
