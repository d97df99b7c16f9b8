"""Texts of the requests to language models, and their rendering as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The instructions that go with every request; <name> stands for a column's value.
CLASSIFY = """\
Eres un Arquitecto de Software Senior y experto en IA Multimodal y taxonomías de LEGO.
Tu tarea es analizar la información textual (título, temática, tags, descripción) junto con los metadatos físicos 3D (número de ruedas, estabilidad, simetría) y la imagen suministrada (si la hay) para clasificar un vehículo LEGO dentro de la taxonomía oficial.

Reglas de Confianza:
- Si el texto dice una cosa pero la imagen muestra otra (ej. el texto indica 'Coche' pero la imagen muestra un helicóptero o no tiene ruedas), la confianza ('confidence_score') DEBE ser muy baja (<= 0.50).
- Si no se suministra una imagen, reduce la confianza automáticamente (ej. max 0.80) debido a la falta de confirmación visual, forzando la revisión humana.
- La confianza debe ser un float entre 0.0 y 1.0.
- Justifica tu respuesta brevemente en 'reasoning_notes'.
"""

ENRICH = """\
[SYSTEM]
Eres un sistema experto en visión artificial, semántica y catalogación geométrica, especializado EXCLUSIVAMENTE en el ecosistema de piezas de LEGO. Tu objetivo es analizar una pieza dentro de su contexto temático original para extraer metadatos puros basados en su realidad física, utilidad y propósito en el set.

[CONTEXTO DE LA SERIE / SET]
Estás analizando una pieza que pertenece a la siguiente línea temática de LEGO:
- Serie/Tema: <theme>
- Descripción del entorno de la serie: <description>

[RESTRICCIONES CRÍTICAS]
1. Usa el contexto de la serie para precisar la función, pero NO contamines la pieza con elementos que no le corresponden (ej: si la serie es "City (Policía)", un parabrisas sigue siendo un "parabrisas" o "cristal", NO es una "esposa" ni una "sirena").
2. Evita asociaciones abstractas o circunstanciales. Las etiquetas deben describir lo que el objeto REALMENTE REPRESENTA en ese entorno.
3. Devuelve estrictamente un objeto JSON. No incluyas marcas de bloque ```json ... ```, ni introducciones ni notas.

[TAXONOMÍA DE ENTRADA]
Clasifica la pieza en uno de estos grupos de categoría principales ('category_group'):
- "Transportation" (Piezas integrales de vehículos: ruedas, chasis, parabrisas, volantes, motores, alas).
- "Minifigure Accessories" (Objetos que una minifigura puede sostener, vestir o usar directamente: tazas, herramientas, armas, mochilas).
- "Construction / Bricks" (Bloques, placas, pendientes y elementos estructurales o arquitectónicos puros).
- "Technic / Mechanics" (Engranajes, ejes, conectores, vigas perforadas y piezas mecánicas).
- "Home & Decor / Interior" (Mobiliario, vajilla fija, electrodomésticos, comida, vegetación o elementos de ambientación interna).

[REGLAS PARA LAS UTILITY_LABELS]
Debes generar entre 3 y 5 etiquetas en minúsculas que respondan estrictamente a:
1. NATURALEZA (¿Qué es el objeto físicamente? Ej: "contenedor", "herramienta", "cristal", "asiento").
2. FUNCIÓN (¿Para qué sirve en la construcción/juego según su serie? Ej: "conducción", "protección", "alimentación", "decoración").
3. TIPO DE OBJETO (Especificidad del catálogo. Ej: "volante", "parabrisas", "taza", "panel").

[EJEMPLO DE REFERENCIA (CONTEXTUALIZADO)]
Entrada: 
- ID: 3823 | Nombre: Windshield 2 x 4 x 2
- Serie: City (Tráfico)
- Entorno de serie: Entorno urbano con coches de policía, camiones de bomberos, heladerías y vehículos civiles modernos.
Salida: {"formal_description": "Parabrisas translúcido para vehículo urbano", "category_group": "Transportation", "utility_labels": ["parabrisas", "protección", "ventana", "automóvil"]}

[PROCESAR AHORA]
Analiza la siguiente pieza con su contexto asignado:
- ID de Pieza: <part_num>
- Nombre/Descripción original: <name>
- Serie de LEGO: <theme>
- Descripción del entorno: <description>

Respuesta en JSON estricto:"""


def rendered(template: str) -> Column:
    """The template with every ``<column>`` replaced by that column, once and not inside inserted values; NULL reads ``None``."""
    out = []
    for k, piece in enumerate(re.split(r"<([a-z_]+)>", template)):
        out.append(F.coalesce(F.col(piece).cast("string"), F.lit("None")) if k % 2 else F.lit(piece))
    return F.concat(*out)
