"""Explicit types of the engine's tables; nothing is inferred."""

SERIES = "struct<name:string,values:array<double>,kind:string>"
CHART = f"struct<chart_type:string,title:string,value_axis_title:string,value_format:string,stacked:boolean,categories:array<string>,series:array<{SERIES}>>"
#: A cache of chart points as written: which variant, whether its cache is there, and its points in order.
CACHE = "struct<variant:string,present:boolean,format:string,pt_count:string,points:array<struct<idx:string,v:string>>>"
RAW_SERIES = f"struct<parent:string,bar_dir:string,name:{CACHE},name_text:string,cat:{CACHE},val:{CACHE}>"
RAW_CHART = f"struct<title:array<string>,has_plot:boolean,plots:array<struct<tag:string,bar_dir:string,grouping:string>>,axis_titles:array<array<string>>,series:array<{RAW_SERIES}>>"
SOURCE = "path string, content binary"
RESULT = "source_id string, format string, status string, error string, markdown string, warnings array<string>, charts_found int, charts_rendered int, groups_found int, vlm_used boolean"
