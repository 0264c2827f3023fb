"""Rules of organisations, projects and invitations as set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.scalar import trim_to_null
from lattica.operators.analytics import at_least, invitation_valid
from lattica.session import written


def members_with_profiles(members: DataFrame, users: DataFrame) -> DataFrame:
    """Every membership, with null profile columns where the user is gone; joined on user_id."""
    return members.join(users, "user_id", "left")


def organisations_of(user_id: int, members: DataFrame, orgs: DataFrame) -> DataFrame:
    """The organisations that a user belongs to; unknown ones drop out."""
    return members.where(F.col("user_id") == user_id).join(orgs, "org_id")


def deletable(orgs: DataFrame, projects: DataFrame) -> DataFrame:
    """Organisations without projects."""
    return orgs.join(projects.select("org_id").distinct(), "org_id", "left_anti")


def left(user_id: int, org_id: int, org_members: DataFrame, project_members: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both membership tables once a user has left an organisation and all its projects; owners can't leave."""
    gone = (F.col("user_id") == user_id) & (F.col("org_id") == org_id) & (F.col("role") != "OWNER")
    leaves = org_members.where(gone).select("user_id", "org_id")
    of_org = projects.join(leaves, "org_id").select("user_id", "project_id")
    return org_members.join(leaves, ["user_id", "org_id"], "left_anti"), project_members.join(of_org, ["user_id", "project_id"], "left_anti")


def member_changes(members: DataFrame, changes: DataFrame) -> DataFrame:
    """Each change with a status: the owner is immutable, strangers are unknown.

    members: project_id, user_id, role; changes: project_id, user_id, new_role (null: remove)."""
    j = changes.join(members, ["project_id", "user_id"], "left")
    status = F.when(F.col("role").isNull(), "NOT_FOUND").when((F.col("role") == "OWNER") | (F.col("new_role") == "OWNER"), "FORBIDDEN").when(F.col("new_role").isNull(), "REMOVED").otherwise("UPDATED")
    return j.withColumn("status", status)


def invited(invitations: DataFrame, asked: DataFrame, now) -> DataFrame:
    """Each request with what becomes of it: a new row, a renewed expired one, or a conflict.

    invitations: org_id, email, status, expires_at; asked: org_id, email."""
    open_ = invitations.where("status = 'PENDING'").groupBy("org_id", F.lower("email").alias("email")).agg(F.max("expires_at").alias("expires_at"))
    j = asked.withColumn("email", F.lower("email")).join(open_, ["org_id", "email"], "left")
    return j.withColumn("result", F.when(F.col("expires_at").isNull(), "CREATED").when(F.col("expires_at") < now, "RENEWED").otherwise("CONFLICT")).drop("expires_at")


def noted(notes: DataFrame, asked: DataFrame, members: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """The new rows of notes, and each request with its outcome (ADDED, EMPTY, FORBIDDEN).

    notes: note_id, project_id, author_id, text, created_at; asked: project_id, author_id, text; members: project_id,
    user_id. Only members add notes, and none without text; numbers go on from the greatest, by project and author."""
    inside = members.select("project_id", F.col("user_id").alias("author_id"), F.lit(True).alias("inside")).distinct()
    text = trim_to_null(F.col("text"))
    judged = written(asked.join(inside, ["project_id", "author_id"], "left").withColumn("text", text).withColumn("result", F.when(F.col("inside").isNull(), "FORBIDDEN").when(F.col("text").isNull(), "EMPTY").otherwise("ADDED")).drop("inside"), "notes")
    last = notes.agg(F.coalesce(F.max("note_id"), F.lit(0)).alias("last"))
    fresh = judged.where("result = 'ADDED'").withColumn("rank", F.row_number().over(Window.partitionBy("project_id").orderBy("author_id", "text")))
    before = fresh.groupBy("project_id").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("project_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a project
    numbered = fresh.join(before, "project_id").crossJoin(F.broadcast(last)).withColumn("note_id", F.col("last") + F.col("before") + F.col("rank"))
    return numbered.select("note_id", "project_id", "author_id", "text", now.alias("created_at")), judged


def deletable_notes(notes: DataFrame, members: DataFrame, user_id: int) -> DataFrame:
    """Notes that a user may delete: their own, or all in projects where they rank ADMIN or higher."""
    role = members.where(F.col("user_id") == user_id).select("project_id", "role")
    return notes.join(role, "project_id", "left").where((F.col("author_id") == user_id) | at_least(F.col("role"), "ADMIN")).drop("role")


def accepted(invitations: DataFrame, asked: DataFrame, now) -> DataFrame:
    """Each request to accept with its outcome, and the role that an accepted one brings.

    invitations: invitation_id, org_id, email, role, status, expires_at; asked: invitation_id, user_id, email."""
    j = asked.withColumnRenamed("email", "user_email").join(invitations, "invitation_id", "left")
    good = invitation_valid(F.col("status"), F.col("expires_at"), F.col("email"), F.col("user_email"), now)
    result = F.when(F.col("status").isNull(), "NOT_FOUND").when(good, "ACCEPTED").when(F.col("status") != "PENDING", "CLOSED").when(F.col("expires_at") < now, "EXPIRED").otherwise("FORBIDDEN")
    out = j.withColumn("result", result)
    return out.select("invitation_id", "user_id", "org_id", "result", F.when(F.col("result") == "ACCEPTED", F.col("role")).alias("role"))
