"""The acceptance gate of retrieval: 22 queries over trees of four frameworks, walked, indexed and queried, in both recall modes."""

import os

import pytest

from ctxforge.jobs.evaluation import evaluate

TREES = {
    "vue": {
        "vite.config.ts": "import { defineConfig } from 'vite'\nexport default defineConfig({ plugins: [] })\n",
        "components.d.ts": "declare module 'vue' {\n  export interface GlobalComponents { UserCard: unknown; SeatPicker: unknown }\n}\n",
        "src/main.ts": "import { createApp } from 'vue'\nimport App from './App.vue'\ncreateApp(App).mount('#app')\n",
        "src/App.vue": "<template><main><slot /></main></template>\n",
        "src/router/index.ts": "import { createRouter } from 'vue-router'\nexport default createRouter({ routes: [\n  { path: '/', name: 'start' },\n  { path: '/orders', name: 'orders' },\n] })\n",
        "src/stores/user.ts": "import { defineStore } from 'pinia'\nexport const useUserStore = defineStore('user', () => ({ name: '' }))\n",
        "src/stores/order.ts": "import { defineStore } from 'pinia'\nexport const useOrderStore = defineStore('order', () => ({ list: [] }))\n",
        "src/pages/StartPage.vue": "<template><h1>Start</h1></template>\n",
        "src/pages/OrderListPage.vue": "<script setup lang=\"ts\">\nimport { fetchOrders } from '../services/orderApi'\nconst orders = await fetchOrders()\n</script>\n<template><ul><li v-for=\"o in orders\">{{ o.id }}</li></ul></template>\n",
        "src/components/UserCard.vue": "<template><article>card of a user</article></template>\n",
        "src/components/SeatPicker.vue": "<template><select /></template>\n",
        "src/services/orderApi.ts": "export async function fetchOrders() {\n  return (await fetch('/orders')).json()\n}\n",
        "src/composables/useAuth.ts": "export const useAuth = () => ({ login: async () => true })\n",
    },
    "angular": {
        "angular.json": "{ \"projects\": { \"shop\": {} } }\n",
        "src/app/app.module.ts": "import { NgModule } from '@angular/core'\n@NgModule({ declarations: [], imports: [] })\nexport class AppModule {}\n",
        "src/app/app-routing.module.ts": "import { RouterModule } from '@angular/router'\nconst routes = [{ path: 'users' }, { path: 'orders' }]\n@NgModule({ imports: [RouterModule.forRoot(routes)] })\nexport class AppRoutingModule {}\n",
        "src/app/user/user.component.ts": "import { Component } from '@angular/core'\n@Component({ selector: 'app-user', template: '<p>user</p>' })\nexport class UserComponent {}\n",
        "src/app/user/user.service.ts": "import { Injectable } from '@angular/core'\n@Injectable({ providedIn: 'root' })\nexport class UserService { load() {} }\n",
        "src/app/order/order.component.ts": "import { Component } from '@angular/core'\n@Component({ selector: 'app-order', template: '<p>order</p>' })\nexport class OrderComponent {}\n",
    },
    "react": {
        "package.json": "{ \"dependencies\": { \"react\": \"18\" } }\n",
        "src/main.tsx": "import { createRoot } from 'react-dom/client'\ncreateRoot(document.body).render(null)\n",
        "src/router.tsx": "import { createBrowserRouter } from 'react-router-dom'\nexport const router = createBrowserRouter([{ path: '/' }, { path: '/board' }])\n",
        "src/pages/Dashboard.tsx": "export default function Dashboard() {\n  return <section>numbers</section>\n}\n",
        "src/components/Button.tsx": "export function Button() {\n  return <button />\n}\n",
        "src/store/counterSlice.ts": "import { createSlice } from '@reduxjs/toolkit'\nexport const slice = createSlice({ name: 'counter', initialState: 0, reducers: {} })\n",
        "src/hooks/useUser.ts": "export function useUser() {\n  return { id: 1 }\n}\n",
        "src/services/userApi.ts": "export async function getUser(id: number) {\n  return fetch(`/users/${id}`)\n}\n",
    },
    "spring": {
        "pom.xml": "<project><artifactId>shop</artifactId></project>\n",
        "src/main/java/com/example/Application.java": "package com.example;\n@SpringBootApplication\npublic class Application { public static void main(String[] a) {} }\n",
        "src/main/java/com/example/controller/OrderController.java": "package com.example.controller;\n@RestController\npublic class OrderController {\n  @GetMapping(\"/orders\")\n  public Object all() { return null; }\n}\n",
        "src/main/java/com/example/service/OrderService.java": "package com.example.service;\n@Service\npublic class OrderService { }\n",
        "src/main/java/com/example/repository/OrderRepository.java": "package com.example.repository;\npublic interface OrderRepository extends JpaRepository<Order, Long> { }\n",
        "src/main/java/com/example/entity/Order.java": "package com.example.entity;\n@Entity\npublic class Order { Long id; }\n",
    },
}
JAVA = "src/main/java/com/example"
# The queries of the gate and the file that each should find.
CASES = {
    "vue": [
        ("Vue 路由 router 配置 routes", "src/router/index.ts"), ("用户 store 状态管理 pinia", "src/stores/user.ts"), ("订单列表 页面 page view", "src/pages/OrderListPage.vue"),
        ("UserCard 组件 component", "src/components/UserCard.vue"), ("订单 service api 接口 fetchOrders", "src/services/orderApi.ts"), ("useAuth composable 登录 hook", "src/composables/useAuth.ts"),
    ],
    "angular": [
        ("Angular 路由 routing module", "src/app/app-routing.module.ts"), ("user component 组件 视图", "src/app/user/user.component.ts"), ("user service 服务 注入 injectable", "src/app/user/user.service.ts"),
        ("order 组件 component", "src/app/order/order.component.ts"), ("ng module 模块 app", "src/app/app.module.ts"),
    ],
    "react": [
        ("react 路由 route router", "src/router.tsx"), ("Dashboard 页面 component", "src/pages/Dashboard.tsx"), ("Button 组件 component", "src/components/Button.tsx"),
        ("counter store redux slice 状态", "src/store/counterSlice.ts"), ("useUser hook 钩子", "src/hooks/useUser.ts"), ("user service api getUser 接口", "src/services/userApi.ts"),
    ],
    "spring": [
        ("OrderController controller endpoint orders mapping 接口", f"{JAVA}/controller/OrderController.java"), ("order service 服务 业务", f"{JAVA}/service/OrderService.java"),
        ("order repository 持久化 dao mapper 仓储", f"{JAVA}/repository/OrderRepository.java"), ("order entity 实体", f"{JAVA}/entity/Order.java"), ("spring boot application 启动 入口", f"{JAVA}/Application.java"),
    ],
}


@pytest.mark.parametrize("fulltext", [True, False])
def test_gate(spark, tmp_path, fulltext):
    for grp, files in TREES.items():
        for name, text in files.items():
            os.makedirs(os.path.dirname(f"{tmp_path}/{grp}/{name}"), exist_ok=True)
            with open(f"{tmp_path}/{grp}/{name}", "w") as f:
                f.write(text)
    cases = spark.createDataFrame([(f"{grp}{i}", grp, q, p) for grp, some in CASES.items() for i, (q, p) in enumerate(some)], "query_id string, grp string, query string, path string")
    ranks, rate = evaluate(spark, {grp: f"file://{tmp_path}/{grp}" for grp in TREES}, cases, fulltext=fulltext)
    rank = {r.query_id: r.first_rank for r in ranks.collect()}
    rates = {r.grp: r for r in rate.collect()}
    print(fulltext, rank, {k: r.hit_rate for k, r in rates.items()})
    assert len(rank) == rates[None].queries == 22 and rates[None].passed and rates[None].hit_rate >= 0.80
    assert {g: r.queries for g, r in rates.items() if g} == {g: len(c) for g, c in CASES.items()} and all(r.hit_rate >= 0.60 for r in rates.values())
    assert sum(r is not None and r <= 5 for r in rank.values()) == rates[None].hits
