"""Schemas of parsed source files."""

from __future__ import annotations

from pyspark.sql.types import StructType

_CALL = "struct<callee:string,defined_in:string,line:int,args:array<string>,is_conditional:boolean,context:string>"
_PATH = "struct<calls:array<string>,returns:string,raises:string>"
_FLOW = (
    f"struct<complexity:int,branches:array<struct<branch_type:string,condition:string,line:int,true_path:{_PATH},false_path:{_PATH}>>,"
    "loops:array<struct<loop_type:string,condition:string,line:int,calls:array<string>>>,"
    "try_blocks:array<struct<line:int,try_calls:array<string>,except_clauses:array<struct<exception_type:string,line:int,calls:array<string>>>,finally_calls:array<string>>>>"
)
_VARIABLE = "struct<name:string,var_type:string,scope:string,defined_at:int,transformations:array<struct<line:int,via:string,becomes:string>>,used_in:array<string>,returned:boolean>"
FUNCTION = (
    "struct<kind:string,class_name:string,id:string,name:string,signature:string,params:array<struct<name:string,type_annotation:string,default_value:string>>,"
    f"return_type:string,docstring:string,line_start:int,line_end:int,calls:array<{_CALL}>,variables:array<{_VARIABLE}>,control_flow:{_FLOW},"
    "exceptions:struct<raises:array<string>,propagates:array<string>,handles:array<string>>,complexity:int,is_async:boolean,decorators:array<string>,tags:array<string>,importance_score:float>"
)
CLASS = "struct<id:string,name:string,bases:array<string>,docstring:string,line_start:int,line_end:int,attributes:array<struct<name:string,type_annotation:string,value:string>>,decorators:array<string>>"
PARSED = (
    "path string, lang string, loc long, error string, imports array<struct<module:string,items:array<string>,type:string>>, "
    f"functions array<{FUNCTION}>, classes array<{CLASS}>, global_vars array<struct<name:string,type_annotation:string,value:string,line:int>>, "
    "todos array<struct<line:int,text:string,priority:string>>, security_notes array<struct<line:int,note_type:string,description:string>>"
)


def parsed_schema() -> StructType:
    return StructType.fromDDL(PARSED)
