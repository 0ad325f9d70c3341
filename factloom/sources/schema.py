"""Explicit schemas of the fact tables of a program. Ids are longs, unique in a module; node
-1 is the virtual exit of a function and -100 the unknown callee."""

EXIT = -1
UNKNOWN = -100
LAMBDA = -1  # the always-true fact of interprocedural problems; never null, so that it joins

TABLES = {
    "functions": "module_id string, fn_id long, name string, is_external boolean, type_id long",
    "arguments": "fn_id long, pos int, value_id long, name string, type_id long",
    "globals": "value_id long, name string, kind string, type_id long, init_value_id long",
    "blocks": "fn_id long, block_id long, ord int, name string",
    "instructions": "inst_id long, fn_id long, block_id long, ord int, opcode string, type_id long, name string, pred string",
    "operands": "inst_id long, role string, pos int, value_id long, block_id long",
    "values": "value_id long, kind string, type_id long, name string",
    "constants": "value_id long, ckind string, int_value long, elements array<long>, expr_inst_id long",
    "types": "type_id long, kind string, elem_type_id long, n_elems long, struct_name string, fields array<long>, rendered string",
}
