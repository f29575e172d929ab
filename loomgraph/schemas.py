"""Schemas of the tables that the jobs exchange."""

IMPORT = "struct<type:string,module:string,name:string,alias:string,level:int>"
DECORATOR = "struct<name:string,args:array<string>,path:string>"
FUNCTION = f"struct<pos:int,fn_key:string,name:string,class:string,args:array<string>,arg_types:map<string,string>,decorators:array<{DECORATOR}>,calls:array<string>,kind:string,returns:string>"
PARSED = f"task_id long, key string, error string, imports array<{IMPORT}>, routers map<string,string>, functions array<{FUNCTION}>"
#: Bodies of a graph part; exactly one is set.
PART_BODIES = {
    "requirements": "struct<total:long,requirements:array<string>>",
    "endpoints": "struct<total:long,endpoints:map<string,string>>",
    "architecture": "struct<parent:string,children:array<string>>",
}
TASK = "task_id long, project_path string, broken string"
#: Stages of a task in the order of their parts (fixed spelling).
STATUSES = ("START", "REQUIREMENTS", "ENDPOINTS", "ARHITECTURE", "DONE")
