"""Explicit schemas of the corpus datasets."""

from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "strings": T.ArrayType(T.StringType()), "ints": T.ArrayType(T.IntegerType()),
}


def _fields(text: str) -> T.StructType:
    """A struct of 'name:kind' words; needs no session, unlike DDL."""
    pairs = (word.split(":") for word in text.split())
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


POSITION = _fields(
    "page_start:int page_end:int char_start:long char_end:long estimated:boolean note:string locator_type:string value:ints"
)
_HEAD = _fields("chunk_id:string text:string source_type:string file:string course:string chunk_type:string name:string")
_TAIL = _fields(
    "source_citation:string quality:string previous_quality:string parsed_by:string chunk_quality_flag:strings "
    "extraction_confidence:string source_note:string ocr_confidence:double docstring:boolean error:string"
)
CHUNK = T.StructType([*_HEAD, T.StructField("position", POSITION), *_TAIL])
CONTENT_BLOCK = "type string, text string, code_body string, table_body string, img_path string, page_idx int"
_SPANS = "lines: array<struct<spans: array<struct<type: string, score: double>>>>"
MIDDLE = f"pdf_info array<struct<preproc_blocks: array<struct<blocks: array<struct<{_SPANS}>>, {_SPANS}>>>>"
REPORT = "idx string, file string, course string, needs_llamaparse string, pages string, reasons string, md_file string, error string"
EVALUATION = (
    "chunk_id string, test_category string, abstention_type string, source_type string, chunk_type string, "
    "quality string, question string, reference string, retrieved_ids array<string>, contexts array<string>, "
    "target_retrieved boolean, response string, faithfulness double, answer_relevancy double, "
    "context_precision double, context_recall double, abstention_honesty boolean"
)
