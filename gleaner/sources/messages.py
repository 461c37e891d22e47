"""Messages of a browser's debugging connection, told apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def route(message: Column) -> Column:
    """Where a message (JSON text) goes: (kind, id, method, body).

    With an id it answers a call: ``failure`` with the error's text, else ``reply``
    with the result, JSON null where there is none.  With a method alone it is an
    ``event`` with its parameters.  Anything else is ``unknown``.
    """
    call = F.get_json_object(message, "$.id").try_cast("long")
    method = F.get_json_object(message, "$.method")
    error = F.get_json_object(message, "$.error.message")
    kind = F.when(call.isNotNull() & error.isNotNull(), "failure").when(call.isNotNull(), "reply").when(method.isNotNull(), "event").otherwise("unknown")
    body = F.when(call.isNotNull(), F.coalesce(error, F.get_json_object(message, "$.result"), F.lit("null"))).when(method.isNotNull(), F.coalesce(F.get_json_object(message, "$.params"), F.lit("null")))
    return F.struct(kind.alias("kind"), call.alias("id"), F.when(call.isNull(), method).alias("method"), body.alias("body"))
