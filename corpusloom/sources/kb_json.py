"""Knowledge bases, indices and embeddings that other programs wrote as nested JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import CLASS, FUNCTION, PARSED

_NAMED = FUNCTION.replace("struct<kind:string,class_name:string,", "struct<", 1)
_CLASS = CLASS.replace("attributes:", f"methods:array<{_NAMED}>,attributes:", 1)
_FILE = (
    f"struct<language:string,loc:bigint,imports:array<struct<module:string,items:array<string>,type:string>>,functions:array<{_NAMED}>,classes:array<{_CLASS}>,"
    "global_vars:array<struct<name:string,type_annotation:string,value:string,line:int>>,todos:array<struct<line:int,text:string,priority:string>>,security_notes:array<struct<line:int,note_type:string,description:string>>>"
)
_POINT = "struct<type:string,path:string,function:string,handler:string,file:string,line:int,methods:array<string>>"
DOCUMENT = f"structure map<string,{_FILE}>, call_graph struct<nodes:array<struct<id:string,type:string,file:string,is_entry_point:boolean,call_count_estimate:bigint>>,edges:array<struct<from:string,to:string,type:string,conditional:boolean,call_site_line:int>>>, entry_points array<{_POINT}>, external_dependencies array<struct<name:string,version:string,source:string,used_by:array<string>,import_count:bigint>>"
INDEX = ", ".join(f"{name} map<string,array<string>>" for name in ("functions_by_name", "functions_calling", "functions_by_tag", "types_by_name", "files_by_category"))
EMBEDDINGS = "model string, dimension int, total_chunks bigint, embeddings array<struct<id:string,chunk_type:string,content:string,embedding:array<float>,metadata:struct<file_path:string,language:string,line_start:int,line_end:int,name:string,complexity:int>>>"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(StructType.fromDDL(schema)).json(path, multiLine=True)


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """PARSED rows of knowledge-base documents, so that ``plans.analyze.tables`` takes them like parsed files."""
    files = _read(spark, path, DOCUMENT).select(F.explode("structure").alias("path", "f"))

    def placed(function: Column, kind: str, name: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("class_name"), *(function[x].alias(x) for x in _fields()))

    own = F.transform(F.coalesce("f.functions", F.array()), lambda x: placed(x, "function", F.lit(None).cast("string")))
    of_classes = F.flatten(F.transform(F.coalesce("f.classes", F.array()), lambda c: F.transform(F.coalesce(c["methods"], F.array()), lambda m: placed(m, "method", c["name"]))))
    classes = F.transform("f.classes", lambda c: c.dropFields("methods"))
    columns = {"path": F.col("path"), "lang": F.initcap("f.language"), "loc": F.col("f.loc"), "error": F.lit(None), "imports": F.col("f.imports"), "functions": F.concat(own, of_classes), "classes": classes, "global_vars": F.col("f.global_vars"), "todos": F.col("f.todos"), "security_notes": F.col("f.security_notes")}
    return files.select(*(columns[f.name].cast(f.dataType).alias(f.name) for f in StructType.fromDDL(PARSED)))


def _fields() -> list[str]:
    return [f.name for f in StructType.fromDDL(f"f {_NAMED}")["f"].dataType]


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst_name, edge_type, conditional, line) of call-graph edges."""
    return _read(spark, path, DOCUMENT).select(F.explode("call_graph.edges").alias("e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst_name"), F.col("e.type").alias("edge_type"), "e.conditional", F.col("e.call_site_line").alias("line"))


def read_index(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(key, values) of one index of an index document."""
    return _read(spark, path, INDEX).select(F.explode(name).alias("key", "values"))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(id, chunk_type, content, embedding, file_path, language, ...) of an embeddings document."""
    return _read(spark, path, EMBEDDINGS).select(F.explode("embeddings").alias("e"), "model").select("e.id", F.lower("e.chunk_type").alias("chunk_type"), "e.content", "e.embedding", "e.metadata.*", "model")
